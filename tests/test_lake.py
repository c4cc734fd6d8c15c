import datetime as dt

from pyspark.sql import functions as F

from matchday.plans import lake


def test_a_hot_team_has_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "PER_DOCUMENT", 100)
    n = 3000
    rows = [(i, 2 if i % 3 == 0 else 2 * (i % 50 + 2), "FO"[i % 2], 1000.0 * (i % 300), dt.datetime(1995, 1, 1) + dt.timedelta(i % 2000), "1-URGENT")
            for i in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    docs = lake.team_documents(spark, str(tmp_path), *lake.LOADS[0])
    sizes = docs.select("team_name", F.size("results").alias("n"), F.size("statistics").alias("s")).collect()
    assert max(r.n for r in sizes) <= 100 and sum(r.n for r in sizes) == n
    assert sum(r.n for r in sizes if r.team_name == "2") == n // 3
    assert sum(r.s for r in sizes if r.team_name == "2") == 2


def test_every_key_is_in_the_first_load(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    docs = lake.team_documents(spark, sf, *lake.LOADS[0])
    assert docs.select(F.sum(F.size("results"))).first()[0] == orders.count()
    assert docs.select("team_name").distinct().count() == orders.select("o_custkey").distinct().count()


def test_broken_documents_are_kept_apart(spark, tmp_path):
    import json

    import pytest

    from matchday import schemas
    from matchday.operators.upsert import read_latest
    from matchday.plans import silver
    from matchday.sources.documents import read_documents
    folder = tmp_path / "bronze" / "league" / "load_date=2026-03-21"
    folder.mkdir(parents=True)
    data = ["1", "Ñu", "u", "2", "1", "1", "0", "3", "1", "4", "2.5", "", "x"]
    doc = {"data": [{"Team": "Ñu", "URL": "u", "Data": data}], "_metadata": {"extraction_timestamp": "2026-03-21 09:00:00"}}
    (folder / "a.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    (folder / "b.json").write_text(json.dumps(doc, indent=1)[:60], encoding="utf-8")
    (folder / "c.json").write_text("not json", encoding="utf-8")
    for _ in range(2):       # a rerun quarantines nothing twice
        silver.run_silver(spark, str(tmp_path / "bronze"), str(tmp_path / "silver"), ("league",))
    assert [r.team_name for r in read_latest(spark, f"{tmp_path}/silver/league_standings").collect()] == ["Ñu"]
    bad = read_latest(spark, f"{tmp_path}/silver/quarantine").collect()
    assert sorted(r.source_file[-6:] for r in bad) == ["b.json", "c.json"]
    assert {r.document[:8] for r in bad if r.source_file.endswith("c.json")} == {"not json"}
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read_documents(spark, str(tmp_path / "bronze" / "league"), schemas.LEAGUE_DOC).collect()


def test_file_order_decides_not_size_or_split(spark, tmp_path):
    import json

    from matchday import schemas
    from matchday.plans.enrich import enrich_players
    from matchday.sources.documents import POSITION, read_rows
    # the later file is the larger one; names contain one another
    (tmp_path / "a.json").write_text(json.dumps([{"name": "Ayo Ràmos Neto", "club": "first"}, {"name": "Ayo Ramos", "club": "second"}]), "utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"name": "Ayo", "club": "third"}] + [{"name": f"pad {i}", "club": "x" * 50} for i in range(400)]), "utf-8")
    rows = read_rows(spark, str(tmp_path), schemas.PROFILES)
    assert rows.select(POSITION).distinct().count() == rows.count() == 403
    players = spark.createDataFrame([("AYO RAMOS", 1), ("Ayo", 2), ("Éva", 3), (None, 4)], "player_name string, total_goals int")
    got = {r.total_goals: r for r in enrich_players(players, rows.repartition(5)).collect()}
    assert [got[i].club for i in (1, 2, 3, 4)] == ["first", "first", None, None] and POSITION not in got[1].asDict()


def test_alias_chains_are_one_name(spark):
    from matchday.plans.enrich import alias_groups, conform
    links = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("Brighton", "Brighton & Hove"), ("B&HA", "Brighton & Hove"), ("x", "x"), (None, "y")]
    preferred = spark.createDataFrame([("Brighton & Hove", 2), ("B&HA", 5), ("n17", 9)], "name string, file_position int")
    aliases = alias_groups(spark.createDataFrame(links, "a string, b string"), preferred)
    got = {r.name: r.canonical for r in aliases.collect()}
    assert {got[f"n{i}"] for i in range(31)} == {"n17"} and got["x"] == "x" and "y" not in got
    assert got["Brighton"] == got["B&HA"] == got["Brighton & Hove"] == "Brighton & Hove"
    df = spark.createDataFrame([("Brighton", "n3", 1), (None, "other", 2)], "team string, opponent string, name int")
    assert {tuple(r) for r in conform(df, ["team", "opponent"], aliases).collect()} == {(None, "other", 2), ("Brighton & Hove", "n17", 1)}


def test_newest_load_by_folder_names_and_empty_sources(spark, tmp_path):
    import pytest

    from matchday.errors import NoSnapshotError
    from matchday.plans import silver
    from matchday.sources.snapshots import newest_load
    for d in ("2026-03-09", "2026-03-21", "2025-12-31"):
        (tmp_path / "players" / f"load_date={d}").mkdir(parents=True)
    assert newest_load(spark, str(tmp_path / "players")) == "2026-03-21"
    for part in ("league", "teams"):
        with pytest.raises(NoSnapshotError):
            silver.run_silver(spark, str(tmp_path), str(tmp_path / "silver"), (part,))


def test_a_team_with_few_matches_has_one_document_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "PER_DOCUMENT", 100)
    rows = [(i, None if i % 5 == 4 else i % 200, "F", 1000.0, dt.datetime(1995, 1, 1), "1-URGENT") for i in range(2000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    docs = lake.team_documents(spark, str(tmp_path), *lake.LOADS[0]).filter(F.size("results") > 0)
    per_team = {r.team_name: (r.docs, r.n) for r in docs.groupBy("team_name").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("results")).alias("n")).collect()}
    assert sum(n for _, n in per_team.values()) == 2000
    assert all(d == 1 for t, (d, _) in per_team.items() if t is not None) and per_team[None][0] > 1


def test_league_documents_are_computed_once_and_sums_stay_where_they_lie(spark, tmp_path):
    from .conftest import plan_text
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"document {i}"
    lake._write_text(spark.range(5).select(F.format_string("r%d", "id").alias("name"), text("id").alias("value")), f"{tmp_path}/docs")
    assert seen.value == 5 and spark.read.text(f"{tmp_path}/docs").count() == 5
    plan = plan_text(lake.league_documents(spark, "/root/testdata/sf0.001", 0))
    assert "SortMergeJoin" in plan and not any("BroadcastHashJoin" in x and "custkey" in x for x in plan.split("\n\n"))


def test_packed_documents_are_read_as_they_were(spark, tmp_path):
    from matchday.operators.export import write_bronze
    df = spark.createDataFrame([("Ñu", "2024-05-01"), ("b", "2024-05-01")], "a string, load_date string")
    write_bronze(df, f"{tmp_path}/b", "gzip")
    assert all(p.name.endswith(".json.gz") for p in tmp_path.glob("b/load_date=2024-05-01/part-*"))
    assert {r.a for r in spark.read.schema("a string").json(f"{tmp_path}/b").collect()} == {"Ñu", "b"}
