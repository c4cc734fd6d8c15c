"""Property tests against plain-Python models (few examples: each one runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchday.operators import ranking, upsert

KEYS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))
ROWS = st.lists(st.tuples(KEYS, st.integers(0, 9), st.integers(0, 3)), max_size=12)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "k string, v int, t timestamp"


def _ts(i):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=i)


def model_upsert(target, source):
    """MERGE update-all / insert-all with latest-wins source de-duplication."""
    latest = {}
    for k, v, t in source:
        if k is None:
            continue
        if k not in latest or (t, v) > (latest[k][2], latest[k][1]):
            latest[k] = (k, v, t)
    # a null key never matches: every such source row is inserted
    out = list(latest.values()) + [r for r in source if r[0] is None]
    out += [r for r in target if r[0] is None or r[0] not in latest]
    return sorted(out, key=lambda r: (r[0] or "", r[1], r[2]))


@SETTINGS
@given(target=ROWS, source=ROWS)
def test_upsert_matches_model(spark, target, source):
    tgt = [(k, v, _ts(t)) for k, v, t in target]
    src = [(k, v, _ts(t)) for k, v, t in source]
    out = upsert.upsert(spark.createDataFrame(tgt, SCHEMA), spark.createDataFrame(src, SCHEMA), ["k"], "t", ["v"])
    got = sorted(((r.k, r.v, r.t) for r in out.collect()), key=lambda r: (r[0] or "", r[1], r[2]))
    assert got == model_upsert(tgt, src)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=40),
       parts=st.integers(1, 6))
def test_global_rank_matches_sort(spark, rows, parts):
    data = [(i, a, b) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, a int, b int")
    order = [F.col("a").desc(), F.col("b").asc(), F.col("id").asc()]
    got = {r.id: r.rank for r in ranking.global_row_number(df, order, "rank", parts).collect()}
    exp = sorted(data, key=lambda r: (-r[1], r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(exp)}
