import json

from pyspark.sql import functions as F

from matchday.operators import buckets, ledger, upsert
from matchday.plans import silver

KV = "k string, d date, v int, m map<string,string>"


def _rows(df):
    return sorted((r.k or "", r.v, str(r.d), str(r.m)) for r in df.collect())


def test_a_rerun_adds_no_row_without_a_key(spark, tmp_path):
    from datetime import date
    day = date(2026, 3, 1)
    one = [("a", day, 1, None), (None, day, 2, {"x": "1"}), (None, day, 2, {"x": "1"}), ("a", None, 2, None), ("a", None, 3, None),
           (None, None, 4, {"y": None})]
    two = [("a", day, 10, None), ("a", None, 3, None), ("b", None, 3, None)]
    load, later = spark.createDataFrame(one, KV), spark.createDataFrame(two, KV)
    want = sorted((r[0] or "", r[2], str(r[1]), str(r[3])) for r in one)
    both = sorted((r[0] or "", r[2], str(r[1]), str(r[3])) for r in one[1:4] + one[5:] + two)
    for merge, read in ((upsert.merge_into, upsert.read_latest), (buckets.merge_buckets, buckets.read_buckets)):
        path = f"{tmp_path}/{merge.__name__}"
        for _ in range(3):
            merge(spark, path, load, ["k", "d"], "v")
            assert _rows(read(spark, path)) == want
        for _ in range(2):
            merge(spark, path, later, ["k", "d"], "v")
            assert _rows(read(spark, path)) == both


def test_swapped_nulls_are_different_rows(spark):
    s = "a int, b int, v int"
    target, source = spark.createDataFrame([(1, None, 5)], s), spark.createDataFrame([(None, 1, 5)], s)
    assert upsert.upsert(target, source, ["a", "b"], "v").count() == 2


def _league(folder, name, points):
    folder.mkdir(parents=True, exist_ok=True)
    row = ["1", name, "u", "2", "1", "1", "0", "3", "1", str(points), "2.5", "", "x"]
    doc = {"data": [{"Team": name, "URL": "u", "Data": row}], "_metadata": {"extraction_timestamp": "2026-03-21 09:00:00"}}
    (folder / f"{name}.json").write_text(json.dumps(doc))


def test_states_of_loads(spark, tmp_path):
    bronze, made = f"{tmp_path}/bronze", f"{tmp_path}/silver"
    run = lambda **kw: silver.run_silver(spark, bronze, made, ("league",), **kw)
    states = lambda: {(r.part, r.load_date): r.state for r in ledger.states(spark, bronze, made, ("league", "teams")).collect()}
    first, second = (tmp_path / "bronze" / "league" / f"load_date=2026-03-{d}" for d in (14, 21))
    assert states() == {("league", None): "no snapshot", ("teams", None): "no snapshot"}
    _league(first, "A", 4)
    assert states()["league", "2026-03-14"] == "new"
    assert run(only_new=True) == {"league_standings": 0} and states()["league", "2026-03-14"] == "merged"
    assert run(only_new=True) == {} and run() == {"league_standings": 1}
    _league(second, "B", 5)
    assert states() == {("league", "2026-03-14"): "merged", ("league", "2026-03-21"): "new", ("teams", None): "no snapshot"}
    assert run(only_new=True) == {"league_standings": 2}
    _league(first, "A", 400)                       # written again, with other content
    assert states()["league", "2026-03-14"] == "changed" and run(only_new=True) == {"league_standings": 3}
    assert set(states().values()) == {"merged", "no snapshot"}
    got = upsert.read_latest(spark, f"{made}/league_standings").select("team_name", "points").collect()
    assert {tuple(r) for r in got} == {("A", 400), ("B", 5)}


def test_an_absent_source_still_raises(spark, tmp_path):
    import pytest

    from matchday.errors import NoSnapshotError
    for only_new in (False, True):
        with pytest.raises(NoSnapshotError):
            silver.run_silver(spark, f"{tmp_path}/nowhere", f"{tmp_path}/silver", ("teams",), only_new=only_new)


def test_a_merge_is_an_equi_join(spark):
    from .conftest import plan_text
    target = spark.range(100_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    source = spark.range(10).select(F.col("id").alias("k"), F.lit(2).alias("v"))
    out = upsert.upsert(target, source, ["k"], "v")
    out.count()
    plan = plan_text(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "LeftAnti" in plan
