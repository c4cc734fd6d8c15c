import datetime as dt

from pyspark.sql import functions as F

from matchday.operators import upsert

T1 = dt.datetime(2026, 3, 14, 9)
T2 = dt.datetime(2026, 3, 21, 9)
SCHEMA = "team string, v int, updated_at timestamp"


def _rows(df):
    return sorted(((r.team, r.v) for r in df.collect()), key=lambda t: (t[0] or "", t[1]))


def test_upsert_update_insert_keep(spark):
    target = spark.createDataFrame([("a", 1, T1), ("b", 2, T1), (None, 9, T1)], SCHEMA)
    source = spark.createDataFrame([("b", 20, T2), ("c", 30, T2), (None, 90, T2)], SCHEMA)
    out = upsert.upsert(target, source, ["team"])
    # matched b replaced, c inserted, a kept; null keys never match: both kept
    assert _rows(out) == sorted([("a", 1), ("b", 20), ("c", 30), (None, 9), (None, 90)], key=lambda r: (r[0] or "", r[1]))


def test_duplicate_source_keys_latest_wins(spark):
    target = spark.createDataFrame([("a", 1, T1)], SCHEMA)
    source = spark.createDataFrame([("a", 5, T1), ("a", 7, T2)], SCHEMA)
    assert _rows(upsert.upsert(target, source, ["team"])) == [("a", 7)]


def test_upsert_idempotent_and_last_wins(spark):
    target = spark.createDataFrame([("a", 1, T1), ("b", 2, T1)], SCHEMA)
    source = spark.createDataFrame([("b", 20, T2), ("c", 30, T2)], SCHEMA)
    once = upsert.upsert(target, source, ["team"])
    twice = upsert.upsert(once, source, ["team"])
    assert _rows(once) == _rows(twice)
    newer = spark.createDataFrame([("c", 31, T2)], SCHEMA)
    assert dict(_rows(upsert.upsert(twice, newer, ["team"])))["c"] == 31


def test_snapshot_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upsert.latest_version(spark, path) is None
    src1 = spark.createDataFrame([("a", 1, T1), ("a", 2, T1), ("b", 2, T1)], SCHEMA)
    assert upsert.merge_into(spark, path, src1, ["team"]) == 0
    assert len(upsert.read_latest(spark, path).collect()) == 2
    src2 = spark.createDataFrame([("b", 3, T2), ("c", 4, T2)], SCHEMA)
    assert upsert.merge_into(spark, path, src2, ["team"]) == 1
    assert upsert.merge_into(spark, path, src2, ["team"]) == 2  # rerun of the same load
    cur = upsert.read_latest(spark, path)
    assert sorted(r.team for r in cur.collect()) == ["a", "b", "c"]
    assert "snapshot" not in cur.columns
    assert upsert.overwrite(spark, src2, path) == 3
    assert sorted(r.team for r in upsert.read_latest(spark, path).collect()) == ["b", "c"]


def test_dedupe_latest_defined_row(spark):
    df = spark.createDataFrame([("a", 1, T1), ("a", 2, T2), ("a", 3, T2)], SCHEMA)
    out = upsert.dedupe_latest(df, ["team"], "updated_at", ["v"]).collect()
    assert [(r.team, r.v) for r in out] == [("a", 3)]


def test_null_key_source_rows_all_insert(spark):
    target = spark.createDataFrame([("a", 1, T1)], SCHEMA)
    source = spark.createDataFrame([(None, 5, T2), (None, 6, T2), ("a", 2, T2), ("a", 3, T1)], SCHEMA)
    assert _rows(upsert.upsert(target, source, ["team"])) == [(None, 5), (None, 6), ("a", 2)]


def test_half_written_snapshot_is_not_read(spark, tmp_path):
    """A job that died before its commit leaves files without the marker."""
    import os
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "team string, v int, updated_at int")
    assert upsert.merge_into(spark, path, rows, ["team"]) == 0
    rows.limit(1).coalesce(1).write.parquet(f"{path}/snapshot=1")
    os.remove(f"{path}/snapshot=1/_SUCCESS")
    assert upsert.latest_version(spark, path) == 0
    assert upsert.read_latest(spark, path).count() == 2
    assert upsert.merge_into(spark, path, rows.withColumn("updated_at", F.lit(2)), ["team"]) == 1
    assert upsert.read_latest(spark, path).count() == 2


def test_missing_columns_raise(spark):
    import pytest

    from matchday.errors import UnknownColumnError
    target = spark.createDataFrame([("a", 1, 1, 5)], "team string, v int, updated_at int, w int")
    with pytest.raises(UnknownColumnError):
        upsert.upsert(target, target.drop("w"), ["team"])


def test_small_load_does_not_shuffle_the_target(spark, tmp_path):
    from .conftest import plan_text
    path = str(tmp_path / "big")
    spark.range(10_000).selectExpr("id as team", "id as v", "1 as updated_at").write.parquet(path)
    target = spark.read.parquet(path)
    spark.createDataFrame([(1, 2, 3)], "team long, v long, updated_at int").write.parquet(str(tmp_path / "load"))
    load = spark.read.parquet(str(tmp_path / "load"))
    plan = plan_text(upsert.upsert(target, load, ["team"]))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_ties_are_settled_by_all_columns(spark):
    rows = [("a", 1, 7, "p"), ("a", 1, 7, "q")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "team string, updated_at int, x int, y string")
        assert upsert.dedupe_latest(df, ["team"]).first().y == "q"


def test_other_errors_are_not_absence(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from matchday.sources.tables import optional_table
    with pytest.raises(AnalysisException):
        optional_table(lambda: spark.range(3).select("nope"))


def test_a_source_of_latest_rows_is_shuffled_once(spark, tmp_path, monkeypatch):
    from .conftest import plan_text
    keys = ["k", "d"]
    rows = [(i % 50, None if i % 7 == 0 else i % 3, i, i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, d long, updated_at long, v long")
    plans, write = [], upsert.write_snapshot
    monkeypatch.setattr(upsert, "write_snapshot", lambda out, path, version: (plans.append(plan_text(out)), write(out, path, version)))
    for name, latest in (("again", False), ("once", True)):
        for load in (df, df.withColumn("updated_at", F.col("updated_at") + 1000).filter("k < 20").unionByName(df.filter("k < 5"))):
            upsert.merge_into(spark, f"{tmp_path}/{name}", upsert.merge_source(load, keys), keys, latest=latest)
    got = [sorted(map(str, upsert.read_latest(spark, f"{tmp_path}/{n}").collect())) for n in ("again", "once")]
    assert got[0] == got[1]
    assert plans[2].count("Exchange hashpartitioning") + plans[2].count("hashpartitioning(k") < plans[0].count("Exchange hashpartitioning") + plans[0].count("hashpartitioning(k")


def test_rows_without_a_key_are_not_sent_to_the_driver(spark):
    from .conftest import plan_text
    df = spark.createDataFrame([(1, 1), (None, 2)], "k long, v long")
    left = upsert.not_replaced(df, df, ["k"], null_keys=True)
    assert "_row" not in "".join(x for x in plan_text(left).split("\n\n") if "BroadcastHashJoin" in x)
    assert left.collect() == []


def test_many_keys_are_not_broadcast_whatever_the_planner_takes_them_for(spark, tmp_path, monkeypatch):
    """A load packed so well that its estimated size is under the broadcast limit."""
    from .conftest import plan_text
    plans, write = [], upsert.write_snapshot
    monkeypatch.setattr(upsert, "write_snapshot", lambda out, path, version: (plans.append(plan_text(out)), write(out, path, version)))
    for n, joined in ((100_000, "SortMergeJoin"), (100, "BroadcastHashJoin")):
        path = f"{tmp_path}/t{n}"
        for load in (0, 1):
            rows = spark.range(load * n // 2, n + load * n // 2).selectExpr("id as k", f"id + {load} as v", f"{load} as updated_at")
            upsert.merge_into(spark, path, rows, ["k"])
        assert joined in plans[-1] and "LeftAnti" in plans[-1]
        assert len({"SortMergeJoin", "BroadcastHashJoin"} & set(plans[-1].replace("(", " ").split())) == 1
        got = upsert.read_latest(spark, path).agg(F.count(F.lit(1)), F.countDistinct("k"), F.sum("v") - F.sum("k")).first()
        assert tuple(got) == (n + n // 2, n + n // 2, n)


def test_facts_about_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), (None, 1, 5), ("c", None, 5)], "k string, d int, v int")
    assert upsert.key_facts(df, ["k", "d"]) == (True, False)
    assert upsert.key_facts(df.filter("k is not null and d is not null"), ["k", "d"]) == (False, False)
    assert upsert.key_facts(df.filter("false"), ["k"]) == (False, False)
    # few rows with long keys
    assert upsert.key_facts(df.selectExpr("repeat('x', 2000000) as k"), ["k"]) == (False, True)


def test_reruns_of_many_rows_without_a_key_broadcast_nothing(spark, tmp_path, monkeypatch):
    from .conftest import plan_text
    plans, write = [], upsert.write_snapshot
    monkeypatch.setattr(upsert, "write_snapshot", lambda out, path, version: (plans.append(plan_text(out)), write(out, path, version)))
    load = spark.range(100_000).selectExpr("id as k", "if(id % 13 = 0, null, id % 7) as d", "id % 5 as v", "1 as updated_at")
    for _ in range(3):
        upsert.merge_into(spark, f"{tmp_path}/t", load, ["k", "d"])
    assert not any("BroadcastHashJoin" in p for p in plans) and plans[-1].count("LeftAnti") >= 2
    got = upsert.read_latest(spark, f"{tmp_path}/t").agg(F.count(F.lit(1)), F.countDistinct("k"), F.sum("v")).first()
    assert tuple(got) == (100_000, 100_000, 200_000)
