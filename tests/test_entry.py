"""Driver contract: entry() runs, every oracle matches at sf0.001, plans are the intended ones."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from matchday.sources.tables import DRIVER_TABLES

from .conftest import plan_text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "rank" in df.columns
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_every_query_has_oracle_or_is_listed():
    from matchday.plans import lake, testbed
    own = testbed.QUERIES | lake.QUERIES
    assert set(own) <= set(entry.oracle_sql()) | entry.NO_ORACLE and set(own) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not re.match(r"op[0-9]+_", k)))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(srows, df.columns) == _norm(cur.fetchall(), dcols)


NATIVE = ["player_scoring_stats", "team_summary", "match_trends", "tactics", "recent_top20", "upcoming_top20",
          "team_form_last5", "next_fixture", "safe_casts", "upsert_latest", "opponent_lookup"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = plan_text(entry.queries()[name](spark, SF))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_text(entry.queries()["player_scoring_stats"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    # only the needed lineitem columns are read
    scan = [l for l in plan.splitlines() if l.startswith("ReadSchema: struct<l_orderkey")][0]
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_form_limit_is_applied_before_the_shuffle(spark):
    plan = plan_text(entry.queries()["team_form_last5"](spark, SF))
    top = plan.split("\n\n")[0]
    # partial WindowGroupLimit sits below the exchange, final above it
    assert top.index("WindowGroupLimit") < top.index("Exchange")
    assert "Partial" in plan and "Final" in plan


def test_resolution_plans_have_no_cross_product(spark):
    for name in ("name_resolution_contains", "name_resolution_ratio"):
        plan = plan_text(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ratio_resolution_against_difflib(spark, duck):
    """No SQL oracle for the ratio rule: every outcome is checked against the rules."""
    choices = [r[0].lower().strip() for r in duck.execute(
        "SELECT p_name, min(p_partkey) m FROM part GROUP BY 1 ORDER BY m").fetchall()]
    names = {(r[0][:1] + r[0][2:]).lower().strip() for r in duck.execute("SELECT p_name FROM part").fetchall()}

    from .test_resolve import check
    got = {r.name: (r.resolved, r.rule) for r in entry.queries()["name_resolution_ratio"](spark, SF).collect()}
    assert set(got) == names and all(check(n, g, choices) for n, g in got.items())


def test_every_query_documents_its_coverage():
    from matchday.plans import testbed
    assert set(testbed.COVERS) == set(testbed.QUERIES)


def test_oracle_rounding_matches_spark(spark):
    from matchday.plans.testbed import _r
    vals = [517.9 / 200, 1.005, 0.125, -2.675, 1234.5675, 2.5, 1 / 3, 0.0]
    con = duckdb.connect()
    for digits in (2, 3):
        duck = [con.execute(f"SELECT {_r(f'{v!r}::DOUBLE', digits)}").fetchone()[0] for v in vals]
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        sp = [r[0] for r in df.select(pyspark_round("v", digits)).collect()]
        assert duck == sp, (digits, duck, sp)


def pyspark_round(c, digits):
    from pyspark.sql import functions as F
    return F.round(F.col(c), digits)
