import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchday.operators import export, nested, reshape


def test_orient_and_split(spark):
    df = spark.createDataFrame([("A", "B", 2, 1, "2-1"), ("C", "D", None, None, None)],
                               "home string, away string, hg int, ag int, res string")
    played, upcoming = reshape.split_played(df, "res")
    assert played.count() == 1 and upcoming.count() == 1
    sides = {(r.team, r.side): (r.goals_for, r.goals_against) for r in
             reshape.orient_sides(played, "home", "away", "hg", "ag").collect()}
    assert sides == {("A", "h"): (2, 1), ("B", "a"): (1, 2)}


def test_zip_headers_overflow(spark):
    df = spark.createDataFrame([(["Player", "Apps"], ["X", "3", "extra", "more"])], "h array<string>, c array<string>")
    m = df.select(reshape.zip_headers("h", "c").alias("m")).first().m
    assert m == {"Player": "X", "Apps": "3", "Column_2": "extra", "Column_3": "more"}
    short = df.select(reshape.zip_headers("h", "c", reshape.SHORT_OVERFLOW_PREFIX).alias("m")).first().m
    assert short["Col_2"] == "extra"


def test_row_record_nest_flatten(spark):
    df = spark.createDataFrame([(["1", "Arsenal", "u"],)], "d array<string>")
    r = df.select(reshape.row_record("d").alias("r")).first().r
    assert (r.Team, r.URL) == ("Arsenal", "u")
    rows = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a")], "team string, n int, v string")
    nested_df = reshape.nest_by(rows, "team", "results", ["v"], ["n"])
    assert [x.v for x in nested_df.first().results] == ["a", "b"]
    roster = spark.createDataFrame([("T", [("P1", "u1"), ("P2", None)])],
                                   "team_name string, roster array<struct<Player:string, Player_URL:string>>")
    assert [r.player_name for r in reshape.flatten_roster(roster, "team_name", "roster").collect()] == ["P1"]
    arr = spark.createDataFrame([([("", "x"), ("d", "y"), (None, "z")],)], "a array<struct<Date:string, v:string>>")
    assert [x.v for x in arr.select(reshape.drop_blank_rows("a", "Date").alias("a")).first().a] == ["y", "z"]


def test_expand_struct_known_and_extra(spark):
    st = T.StructType([T.StructField("Situation", T.StringType()), T.StructField("xG/Sh", T.StringType()),
                       T.StructField("№", T.StringType()), T.StructField("New", T.StringType())])
    df = spark.createDataFrame([("t", ("Open play", "0.1", "1", "n"))],
                               T.StructType([T.StructField("team", T.StringType()), T.StructField("stat", st)]))
    out = nested.expand_struct(df, "stat", known=["№", "Situation", "xG/Sh", "G"], rest_alias="extra").first()
    assert out["xG/Sh"] == "0.1" and out["№"] == "1" and out["G"] is None and out["extra"] == {"New": "n"}
    assert nested.find_column(df, "TEAM") == "team"
    assert nested.drop_matching(df.withColumn("join_name", F.lit(1)), "join_name").columns == ["team", "stat"]


def test_export_roundtrip_utf8_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("Ødegaard", None, 3)], "name string, club string, goals int")
    path = str(tmp_path / "out")
    export.export_json(df.coalesce(1), path)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    assert len(files) == 1
    line = open(os.path.join(path, files[0]), encoding="utf-8").read().strip()
    assert json.loads(line) == {"name": "Ødegaard", "goals": 3}
    assert "Ødegaard" in line  # not escaped
    back = export.read_export(spark, path, df.schema).first()
    assert back.club is None and back.goals == 3


def test_bronze_stamp_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("A",)], "team_name string")
    stamped = export.stamp(df, "2026-03-21 09:00:00", "2026-03-21", "test").withColumn("load_date", F.lit("2026-03-21"))
    path = str(tmp_path / "b")
    export.write_bronze(stamped, path)
    assert os.path.isdir(str(tmp_path / "b" / "load_date=2026-03-21"))
    # a rerun replaces its load and leaves the others
    export.write_bronze(stamped.withColumn("load_date", F.lit("2026-03-28")), path)
    export.write_bronze(stamped, path)
    assert sorted(str(r.load_date) for r in spark.read.json(path).collect()) == ["2026-03-21", "2026-03-28"]


def test_first_k_and_json_array_file(spark, tmp_path):
    df = spark.createDataFrame([(list(range(50)),)], "a array<int>")
    assert df.select(reshape.first_k("a", 38).alias("a")).first().a == list(range(38))
    # SRC8: a file holding one JSON array of objects reads as one row per object
    p = tmp_path / "badges.json"
    p.write_text(json.dumps([{"team": "A", "badge_url": "a.png"}, {"team": "B", "badge_url": "b.png"}]))
    from matchday import schemas
    from matchday.sources.documents import read_documents
    rows = read_documents(spark, str(p), schemas.BADGES, glob=None).collect()
    assert [(r.team, r.badge_url) for r in rows] == [("A", "a.png"), ("B", "b.png")]


def test_case_insensitive_field_access(spark):
    df = spark.createDataFrame([(("X", "u"),)], "t struct<Team:string, URL:string>")
    assert df.select(F.col("t.url")).first()[0] == "u"  # PRJ3


def test_view_and_optional_source(spark, tmp_path):
    from matchday.operators.upsert import read_latest
    from matchday.sources.tables import optional_table, register_view
    register_view(spark.createDataFrame([(1, "a")], "k int, v string"), "tiny_view")
    assert spark.sql("SELECT v FROM tiny_view WHERE k = 1").first().v == "a"  # SRC9
    missing = str(tmp_path / "nothing_here")
    assert optional_table(lambda: read_latest(spark, missing)) is None  # SRC7
    assert optional_table(lambda: spark.read.parquet(missing)) is None


def test_orient_by_side(spark):
    df = spark.createDataFrame([("h", "2", "1", "1.5", "0.5"), ("a", "2", "1", "1.5", "0.5")],
                               "side string, hs string, aw string, hx string, ax string")
    out = reshape.orient_by_side(df, "side", {"score": ("hs", "aw"), "xg": ("hx", "ax")}).collect()
    assert [(r.team_score, r.opponent_score, r.team_xg, r.opponent_xg) for r in out] == [
        ("2", "1", "1.5", "0.5"), ("1", "2", "0.5", "1.5")]


def test_wrap_rows_into_one_document(spark, tmp_path):
    rows = spark.createDataFrame([("Arsenal", "u1"), ("Chelsea", "u2")], "Team string, URL string")
    doc = export.wrap_rows(rows, [F.col("Team").desc()], 20)
    stamped = export.stamp(doc, "2026-03-21 09:00:00", "2026-03-21", "test").withColumn("load_date", F.lit("2026-03-21"))
    export.write_bronze(stamped, str(tmp_path / "league"))
    back = spark.read.json(str(tmp_path / "league")).first()
    assert [r.Team for r in back.data] == ["Chelsea", "Arsenal"] and back._metadata.source == "test"
    many = spark.range(50).repartition(7)
    assert [r.id for r in export.wrap_rows(many, [F.col("id").desc()], 3).first().data] == [49, 48, 47]


def test_export_json_array(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ødegaard", None), (2, "Saka", 3)], "rank int, name string, goals int").orderBy("rank")
    path = str(tmp_path / "arr")
    export.export_json_array(df, path, [F.col("rank")], 20)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    doc = json.loads(open(os.path.join(path, files[0]), encoding="utf-8").read())
    assert doc == [{"rank": 1, "name": "Ødegaard"}, {"rank": 2, "name": "Saka", "goals": 3}]
