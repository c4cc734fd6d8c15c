"""One key holding a third of all rows: results stay exact, and per-key work is
reduced before the shuffle (partial window limit / partial aggregate)."""

import random

from pyspark.sql import functions as F

from matchday.operators import aggregates, ranking, upsert

from .conftest import plan_text


def _skewed(spark, n=30000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        team = 0 if i % 3 == 0 else rnd.randrange(1, 500)  # team 0 holds a third of the rows
        rows.append((team, i, rnd.randrange(400), rnd.choice("wdl"), rnd.randrange(5)))
    return spark.createDataFrame(rows, "team int, id int, day int, res string, goals int").repartition(8), rows


def test_hot_key_top_k_and_totals(spark):
    df, rows = _skewed(spark)
    order = [F.col("day").desc(), F.col("id").desc()]
    form = {r.team: r.form for r in ranking.ordered_array(df, "team", order, F.upper("res"), 5, "form").collect()}
    hot = sorted((r for r in rows if r[0] == 0), key=lambda r: (-r[2], -r[1]))[:5]
    assert form[0] == [r[3].upper() for r in hot]
    first = {r.team: r.id for r in ranking.first_per_key(df, "team", [F.col("day").asc(), F.col("id").asc()]).collect()}
    assert first[0] == min((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[1]))[1]
    latest = upsert.dedupe_latest(df, ["team"], "day", ["id"]).filter("team = 0").first()
    assert latest.id == max((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[1]))[1]
    top = {r.team: r.top for r in aggregates.top_by(df, "team", "id", "goals", "id", "top").collect()}
    assert top[0] == min((r for r in rows if r[0] == 0), key=lambda r: (-r[4], r[1]))[1]


def test_hot_key_is_reduced_before_the_exchange(spark):
    df, _ = _skewed(spark, 3000)
    plan = plan_text(ranking.ordered_array(df, "team", [F.col("day").desc(), F.col("id").desc()], "res", 5, "f"))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    agg_plan = plan_text(aggregates.top_by(df, "team", "id", "goals", "id", "top"))
    assert "partial_min_by" in agg_plan
