"""Packaged documents, bucketed merges, strict sources, lookup marts, leaders of all measures."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchday.errors import NoSnapshotError, UnknownColumnError
from matchday.operators import buckets, ranking, reshape
from matchday.operators.upsert import LOOKUP_COL, lookup, merge_into, strict_source, table_exists, upsert, write_lookup
from matchday.plans import ingest

from .conftest import plan_text

SF = "/root/testdata/sf0.001"


def test_documents_take_one_shuffle(spark):
    plan = plan_text(ingest.packaged(spark, SF))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Scan parquet") == 2


def test_package_orders_salts_and_keeps_every_row(spark):
    a = spark.createDataFrame([("t", 3, "c"), ("t", 1, "b"), ("t", 1, "a"), ("u", 9, "z"), ("t", None, "n"), ("t", 1, "a")], "team string, n int, v string")
    b = spark.createDataFrame([("t", "x"), (None, "y")], "team string, w string")
    rows = [reshape.part_rows(a, "team", one=F.struct("n", "v")), reshape.part_rows(b, "team", two=F.struct("w"))]
    got = {r.key: r for r in reshape.package_parts(rows, {"one": ["n"], "two": ["w"]}).collect()}
    assert [tuple(x) for x in got["t"].one] == [(None, "n"), (1, "a"), (1, "a"), (1, "b"), (3, "c")]
    assert [x.w for x in got["t"].two] == ["x"] and got["u"].two == [] and [x.w for x in got[None].two] == ["y"]
    dealt = reshape.package_parts(rows, {"one": ["n"], "two": ["w"]}, salt=4).collect()
    assert sorted(x.v for r in dealt for x in r.one) == ["a", "a", "b", "c", "n", "z"] and len(dealt) > 3
    assert reshape.package_parts([rows[0].limit(0)], {"one": ["n"]}).collect() == []


def test_repeated_headers_keep_the_last_cell(spark):
    df = spark.createDataFrame([(["a", "b", "a", None], ["1", "2", "3", "4", "5"]), (["a", "a"], ["1"]), ([], []), (["x"], [None])],
                               "h array<string>, c array<string>")
    got = [r.m for r in df.select(reshape.zip_headers("h", "c").alias("m")).collect()]
    assert got == [{"a": "3", "b": "2", "Column_3": "4", "Column_4": "5"}, {"a": "1"}, {}, {"x": None}]


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/part-*", recursive=True)}


KV = "k long, g string, v string, t int"


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path, keys = str(tmp_path / "table"), ["k", "g"]
    old = spark.createDataFrame([(i, "g", "old", 0) for i in range(400)], KV)
    assert buckets.merge_buckets(spark, path, old, keys, "t", buckets=16) == 0
    before, folders = _files(path), buckets.bucket_folders(spark, path)
    assert len(folders) == 16
    load = spark.createDataFrame([(5, "g", "new", 1), (5, "g", "newest", 2), (1000, "g", "in", 1), (None, "g", "null", 1)], KV)
    touched = {r[0] for r in load.select(buckets.bucket_of(keys, 16)).distinct().collect()}
    assert buckets.merge_buckets(spark, path, load, keys, "t") == 1
    after = buckets.bucket_folders(spark, path)
    assert {b for b in after if after[b] != folders.get(b)} == touched and len(touched) < 5
    assert all(_files(path)[f] == m for f, m in before.items())           # no file of before was touched
    rows = {(r.k, r.v) for r in buckets.read_buckets(spark, path).collect()}
    assert rows == {(i, "old") for i in range(400) if i != 5} | {(5, "newest"), (1000, "in"), (None, "null")}
    # reads by key open their buckets only
    some = buckets.read_buckets(spark, path, keys, spark.createDataFrame([(5, "g")], "k long, g string"))
    assert len(some.inputFiles()) == 1 and some.filter("k = 5").first().v == "newest"
    # what a dead job left doesn't count, and is written over
    base = f"{path}/buckets=16"
    spark.createDataFrame([(5, "g", "dead", 9)], KV).write.parquet(f"{base}/snapshot=2/bucket=3")
    assert {(r.k, r.v) for r in buckets.read_buckets(spark, path).collect()} == rows
    # a rerun of the load changes nothing, but for the row without a key
    buckets.merge_buckets(spark, path, load.filter("k is not null"), keys, "t")
    assert {(r.k, r.v) for r in buckets.read_buckets(spark, path).collect()} == rows
    buckets.compact(spark, path, keys)
    assert {os.path.dirname(f) for f in buckets.bucket_folders(spark, path).values()} == {f"file:{base}/snapshot=3"}
    want = upsert(old, load.filter("k is not null"), keys, "t")
    assert buckets.read_buckets(spark, path).filter("k is not null").exceptAll(want).isEmpty()
    with pytest.raises(UnknownColumnError):
        buckets.merge_buckets(spark, path, load.drop("v"), keys, "t")
    with pytest.raises(NoSnapshotError):
        buckets.read_buckets(spark, str(tmp_path / "none"))


def test_replaced_keys_leave_even_an_emptied_bucket(spark, tmp_path):
    path, by = str(tmp_path / "t"), ["k"]
    rows = spark.createDataFrame([(i, g, "v", 0) for i in range(6) for g in "ab"], KV)
    buckets.merge_buckets(spark, path, rows, ["k", "g"], "t", buckets=64, bucket_by=by)
    gone = spark.createDataFrame([(2,), (3,)], "k long")
    source = spark.createDataFrame([(3, "c", "w", 1)], KV)
    # a dead job that named another bucket changes nothing
    (tmp_path / "t" / "buckets=64" / "touched=1" / "bucket=9").mkdir(parents=True)
    buckets.merge_buckets(spark, path, source, ["k", "g"], "t", bucket_by=by, replace=gone)
    got = sorted((r.k, r.g) for r in buckets.read_buckets(spark, path).collect())
    assert got == sorted([(i, g) for i in (0, 1, 4, 5) for g in "ab"] + [(3, "c")])
    # all rows gone, then back
    every = spark.range(6).withColumnRenamed("id", "k")
    buckets.merge_buckets(spark, path, source.limit(0), ["k", "g"], "t", bucket_by=by, replace=every)
    assert buckets.bucket_folders(spark, path) == {}
    buckets.merge_buckets(spark, path, source, ["k", "g"], "t", bucket_by=by)
    assert buckets.read_buckets(spark, path).count() == 1


def test_refresh_reads_the_changed_players_buckets(spark, tmp_path):
    from matchday.plans import gold
    rows = ingest._player_rows(spark, SF, 0)
    where = [f"{tmp_path}/matches", f"{tmp_path}/mart"]
    gold.refresh_player_scoring(spark, *where, rows, ingest.SEASON)
    before = [buckets.bucket_folders(spark, p) for p in where]
    load = rows.filter("player_name = 'player 7'").withColumn("goals", F.lit(9))
    gold.refresh_player_scoring(spark, *where, load, ingest.SEASON)
    after = [buckets.bucket_folders(spark, p) for p in where]
    assert [sum(a[b] != f for b, f in x.items()) for x, a in zip(before, after)] == [1, 1]
    full = gold.player_scoring_stats(buckets.read_buckets(spark, where[0]), ingest.SEASON)
    mart = buckets.read_buckets(spark, where[1])
    assert full.exceptAll(mart).isEmpty() and mart.exceptAll(full).isEmpty()


def test_strict_sources_fail_in_their_own_plan(spark, tmp_path):
    good = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "y", 0), (None, "a", "z", 0), (None, "a", "z", 0)], KV)
    assert sorted(map(str, strict_source(good, ["k"]).collect())) == sorted(map(str, good.collect()))
    bad = good.union(good.filter("k = 1"))
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="several source rows for one key"):
        merge_into(spark, path, bad, ["k"], "t", strict=True)
    assert not table_exists(spark, path)
    merge_into(spark, path, good, ["k"], "t", strict=True)
    with pytest.raises(Exception, match="several source rows for one key"):
        buckets.merge_buckets(spark, str(tmp_path / "b"), bad, ["k"], "t", strict=True)


def test_lookup_marts_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.range(20_000).select(F.concat(F.lit("Name "), F.col("id")).alias("name"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small files are put together otherwise
    try:
        write_lookup(spark, df.repartition(4), path, F.lower("name"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lookup(spark, path, "name 77").collect() == [("Name 77", 77)] and lookup(spark, path, "nobody").isEmpty()
    assert "PushedFilters: [IsNotNull(lookup_key), EqualTo(lookup_key,name 77)]" in plan_text(lookup(spark, path, "name 77"))
    ranges = []
    for f in glob.glob(f"{path}/snapshot=0/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ranges.append((cols[LOOKUP_COL].statistics.min, cols[LOOKUP_COL].statistics.max))
    assert len(ranges) > 1 and sum(a <= "name 77" <= b for a, b in ranges) == 1


def test_leaders_of_all_measures_scan_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 3, None), ("c", 3, 1.0), (None, None, None)], "n string, x int, y double")
    df.write.parquet(str(tmp_path / "m"))
    out = ranking.leaders_of_all(spark.read.parquet(str(tmp_path / "m")), ["x", "y"], "n", 2)
    assert plan_text(out).split("\n\n")[0].count("Scan parquet") == 1 and "WindowGroupLimit" in plan_text(out)
    assert sorted(map(tuple, out.collect())) == [("x", 1, "b", 3.0), ("x", 2, "c", 3.0), ("y", 1, "a", 2.0), ("y", 2, "c", 1.0)]
    with pytest.raises(UnknownColumnError):
        ranking.leaders_of_all(df, ["nope"], "n", 2)


def test_gold_run_enriches_and_serves_profiles(spark, tmp_path):
    import json

    from matchday.operators.upsert import read_latest
    from matchday.plans import gold, serve, silver

    from . import fixtures
    root = str(tmp_path)
    bronze = fixtures.write_bronze(root)
    for name, rows in (("profiles", fixtures.PROFILES), ("badges", fixtures.BADGES),
                       ("aliases", [{"name": "Brighton", "canonical": "Brighton and Hove Albion"}, {"name": "BHA", "canonical": "Brighton"}])):
        os.makedirs(f"{bronze}/{name}")
        with open(f"{bronze}/{name}/list.json", "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False)
    silver.run_silver(spark, bronze, f"{root}/silver")
    versions = gold.run_gold(spark, f"{root}/silver", f"{root}/gold", f"{root}/export", as_of="2026-03-21", bronze_root=bronze)
    assert {"enriched_players", "enriched_teams", gold.PLAYERS_BY_NAME} <= set(versions)
    # both spellings are one team before the joins, so its form is found
    teams = {r.team_name: r for r in read_latest(spark, f"{root}/gold/enriched_teams").collect()}
    brighton = teams["Brighton and Hove Albion"]
    assert "Brighton" not in teams and brighton.form_array == ["D"] and brighton.badge_url == "b/brighton.png" and len(teams) == 4
    players = {r.player_name: r for r in read_latest(spark, f"{root}/gold/enriched_players").collect()}
    assert players["Ayo Ràmos"].club == "Northside" and players["Ben Oduya"].position == "DF"
    assert serve.profile(spark, f"{root}/gold", "ayo-ràmos").first().club == "Northside"
    assert serve.profile(spark, f"{root}/gold", "no-body").isEmpty()
    # nulls are left out of the export, names keep their accents
    lines = [json.loads(x) for f in glob.glob(f"{root}/export/enriched_players/part-*") for x in open(f, encoding="utf-8")]
    by = {r["player_name"]: r for r in lines}
    assert by["Ayo Ràmos"]["image_url"].startswith("i/") and "image_url" not in by["Ben Oduya"]
