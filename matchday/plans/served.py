"""What users of the marts ask, over marts that were written: documents -> bronze -> silver -> gold -> files.

The documents of `testbed` (a team is a customer, a player a supplier) are written as
JSON, taken through `run_silver` and `run_gold` with lists of badges and profiles,
and exported; the queries read the written marts and exports through `serve`. Names
aren't ASCII (`Tëam 000000007`), some profiles lack a position or have a blank
club, and some players and teams are on no list. The lake is built once per
session and folder of tables; the queries share it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.export import write_bronze
from ..operators.upsert import read_latest
from ..session import shared_dir
from ..sources.documents import META_COL, META_RENAMED, POSITION, read_rows
from ..sources.tables import read_table
from . import gold, serve, silver, testbed

LISTS = 8                       # files of badges and of profiles
TEAM = "TËAM 000000007"         # as a user types it
CLUB = "clüB 3"
RESULTS_FILE = T.StructType([T.StructField("match_date", T.DateType()), T.StructField("home_team", T.StringType()),
                             T.StructField("home_goals", T.IntegerType()), T.StructField("away_goals", T.IntegerType()),
                             T.StructField("away_team", T.StringType())])


def team(key: str):
    return F.format_string("Tëam %09d", F.col(key))


def player(key: str):
    return F.format_string("Plâyer %09d", F.col(key))


def _lists(rows: DataFrame, key: str, row, path: str) -> None:
    """JSON arrays of `row`, a few files."""
    files = rows.groupBy(F.pmod(F.col(key), F.lit(LISTS)).alias("list")).agg(F.array_sort(F.collect_list(F.struct(key, row.alias("r")))).alias("rows"))
    files.select("list", F.to_json(F.transform("rows", lambda x: x["r"])).alias("value")).write.partitionBy("list").text(path)


_BUILT: dict[tuple, str] = {}


def build(spark: SparkSession, sf_dir: str) -> str:
    """The lake's folder: bronze, silver, gold and api (the exports)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _BUILT:
        return _BUILT[key]
    root = shared_dir(spark, "served")
    bronze = f"{root}/bronze"
    teams = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (
        make(spark, sf_dir, team) for make in (testbed.result_documents, testbed.fixture_documents, testbed.statistics_documents)))
    for part, docs in (("league", testbed.league_documents(spark, sf_dir, team)), ("teams", teams),
                       ("players", testbed.player_documents(spark, sf_dir, player))):
        write_bronze(docs.withColumnRenamed(META_RENAMED, META_COL), f"{bronze}/{part}", "gzip")
    _lists(read_table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 4"), "c_custkey",
           F.struct(team("c_custkey").alias("team"), F.concat(F.lit("b/"), F.col("c_custkey"), F.lit(".png")).alias("badge_url")),
           f"{bronze}/badges")
    club = F.when(F.col("s_nationkey") == 0, "").otherwise(F.concat(F.lit("Clüb "), F.col("s_nationkey")))
    _lists(read_table(spark, sf_dir, "supplier").filter("s_suppkey % 7 <> 3"), "s_suppkey",
           F.struct(F.upper(player("s_suppkey")).alias("name"), club.alias("club"), F.when(F.col("s_suppkey") % 2 == 0, "FW").alias("position")),
           f"{bronze}/profiles")
    silver.run_silver(spark, bronze, f"{root}/silver", multiline=False, glob=None)
    gold.run_gold(spark, f"{root}/silver", f"{root}/gold", f"{root}/api", testbed.SEASON_START, bronze_root=bronze, glob=None, cutoff=None)
    _BUILT[key] = root
    return root


def _mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return serve.whole_mart(spark, f"{build(spark, sf_dir)}/gold", name)


def served_league_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    badges = read_rows(spark, f"{build(spark, sf_dir)}/bronze/badges", schemas.BADGES, glob=None)
    return serve.league_table(_mart(spark, sf_dir, "team_summary"), badges).select(
        "rank", "team_name", "points", "goal_difference", "zone", "code", F.array_join("form_array", "").alias("form"),
        "next_opponent", "next_home_away", "team_badge_url", "opponent_badge_url")


def served_enriched_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mart(spark, sf_dir, "enriched_teams").select("rank", "team_name", "badge_url")


def served_default_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.default_row(_mart(spark, sf_dir, "team_summary")).select("rank", "team_name", "points")


def served_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.timeline(_mart(spark, sf_dir, "team_match_trends"), TEAM).select("match_date", "opponent", "outcome", "side")


def served_trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.trend_series(_mart(spark, sf_dir, "team_match_trends"), TEAM)


def served_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.squad(_mart(spark, sf_dir, "enriched_players"), CLUB).select("player_name", "club", "position", "total_goals")


def served_clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player with a club to show: blank and missing ones are named so."""
    return serve.club_label(_mart(spark, sf_dir, "enriched_players")).select("player_name", "club", "club_label", "position")


def served_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of answers to questions for somebody there and for nobody."""
    gold_root = f"{build(spark, sf_dir)}/gold"
    summary, players = _mart(spark, sf_dir, "team_summary"), _mart(spark, sf_dir, "enriched_players")
    asked = {"team": serve.for_team(summary, TEAM), "no team": serve.for_team(summary, "nobody"),
             "profile": serve.profile(spark, gold_root, "plâyer-000000001"),
             "no profile": serve.profile(spark, gold_root, "plâyer-nobody"), "no squad": serve.squad(players, "nobody")}
    return reduce(DataFrame.union, (df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("rows")) for what, df in asked.items()))


def served_player_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported lines of the players: fields without a value are left out, names are as they were."""
    lines = spark.read.text(f"{build(spark, sf_dir)}/api/enriched_players")
    has = lambda f: F.array_contains(F.json_object_keys("value"), f)
    return lines.select(F.get_json_object("value", "$.player_name").alias("player_name"), F.get_json_object("value", "$.club").alias("club"),
                        has("position").alias("has_position"), has("total_xg").alias("has_xg"), has("total_goals").alias("has_goals"))


def served_results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported array of the league's latest results, in its order."""
    rows = read_rows(spark, f"{build(spark, sf_dir)}/api/league_recent_results", RESULTS_FILE, glob=None)
    return rows.select(F.col(POSITION)["at"].alias("place"), *RESULTS_FILE.fieldNames())


def served_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mart(spark, sf_dir, "league_upcoming_fixtures")


def served_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.tactics_performance(_mart(spark, sf_dir, "team_tactics"))


def served_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mart(spark, sf_dir, "player_scoring_stats")


def pipeline_player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_latest(spark, f"{build(spark, sf_dir)}/silver/player_matches").select(
        "player_name", "match_date", "position", "minutes_played", "goals", "assists", "xg", "xa")


QUERIES = {f.__name__: f for f in (
    served_league_table, served_enriched_teams, served_default_team, served_timeline, served_trend_series, served_squad, served_clubs,
    served_not_found, served_player_files, served_results_file, served_upcoming, served_tactics, served_scoring, pipeline_player_matches)}

COVERS = {
    "served_league_table": "Q-API1 Q-UI1 Q-STAND Q-SUM SRC6 SRC8 SNK1 SNK3 JN4 SC9 SC14 ORD1",
    "served_enriched_teams": "Q-ENR FZ1 JN3 PRJ14 SC4 SC5",
    "served_default_team": "ORD8 Q-API1",
    "served_timeline": "Q-UI2 Q-API2 FLT7 SC15 SC18",
    "served_trend_series": "Q-UI6 FLT7 SC10 SC18",
    "served_squad": "Q-UI2 Q-API2 Q-ENR FLT7 ORD5",
    "served_clubs": "SC17 Q-ENR FZ1 SC4",
    "served_not_found": "FLT7 FLT8 FLT11 Q-API2 Q-API3",
    "served_player_files": "SNK5 SNK6 SNK8",
    "served_results_file": "SNK5 SRC8 Q-REC FLT4 ORD3",
    "served_upcoming": "Q-FIX Q-UP FLT4 ORD3",
    "served_tactics": "Q-STATS Q-TAC Q-UI5 FLT2 PRJ11 SC16",
    "served_scoring": "Q-PLAY AGG1 AGG2 AGG3 AGG4 AGG5 FLT3 FLT5",
    "pipeline_player_matches": "Q-PM SRC10 SNK2 SNK4 SET1 PRJ6 PRJ7",
}


def _named(sql: str) -> str:
    """An oracle of `testbed` with this module's names of teams."""
    for key in ("team_key", "r.team_key", "match_key"):
        sql = sql.replace(f"CAST({key} AS VARCHAR)", f"('Tëam ' || lpad(CAST({key} AS VARCHAR), 9, '0'))")
    return sql


_PLAYER = "('Plâyer ' || lpad(CAST(player_key AS VARCHAR), 9, '0'))"
_SCORING = testbed.ORACLE_SQL["gold_player_scoring"].replace("CAST(player_key AS VARCHAR)", _PLAYER)
_SUMMARY, _TRENDS, _TACTICS = (_named(testbed.ORACLE_SQL[f"gold_{m}"]) for m in ("team_summary", "team_match_trends", "team_tactics"))
_BADGES = "SELECT ('Tëam ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS team, 'b/' || c_custkey || '.png' AS badge_url FROM customer WHERE c_custkey % 5 <> 4"
_PLAYERS = f"""SELECT p.*, club, position FROM ({_SCORING}) p LEFT JOIN (
    SELECT {_PLAYER.replace("player_key", "s_suppkey")} AS name, CASE WHEN s_nationkey = 0 THEN '' ELSE 'Clüb ' || s_nationkey END AS club,
           CASE WHEN s_suppkey % 2 = 0 THEN 'FW' END AS position FROM supplier WHERE s_suppkey % 7 <> 3) ON name = player_name"""

ORACLE_SQL = {
    "served_league_table": f"""
  SELECT rank, team_name, points, goal_difference, CASE WHEN rank <= 4 THEN 'top' WHEN rank > count(*) OVER () - 3 THEN 'bottom' ELSE 'mid' END AS zone,
         upper(substr(team_name, 1, 3)) AS code, form, next_opponent, next_home_away, t.badge_url AS team_badge_url, o.badge_url AS opponent_badge_url
  FROM ({_SUMMARY}) LEFT JOIN ({_BADGES}) t ON t.team = team_name LEFT JOIN ({_BADGES}) o ON o.team = next_opponent""",
    "served_enriched_teams": f"SELECT rank, team_name, badge_url FROM ({_SUMMARY}) LEFT JOIN ({_BADGES}) ON team = team_name",
    "served_default_team": f"SELECT rank, team_name, points FROM ({_SUMMARY}) WHERE rank = 1",
    "served_timeline": f"""
  SELECT match_date, opponent, CASE WHEN goals_scored > goals_conceded THEN 'W' WHEN goals_scored < goals_conceded THEN 'L' ELSE 'D' END AS outcome,
         CASE WHEN home_away = 'h' THEN 'HOME' ELSE 'AWAY' END AS side
  FROM ({_TRENDS}) WHERE lower(team_name) = lower('{TEAM}') AND result_status IS NOT NULL""",
    "served_trend_series": f"""
  SELECT match_date, strftime(match_date, '%b %-d') AS date_label, opponent, CASE WHEN home_away = 'h' THEN 'HOME' ELSE 'AWAY' END AS side,
         coalesce(xg_for, 0) AS xg_for, coalesce(xg_against, 0) AS xg_against
  FROM ({_TRENDS}) WHERE lower(team_name) = lower('{TEAM}')""",
    "served_squad": f"""
  SELECT player_name, club, position, total_goals FROM ({_PLAYERS}) WHERE lower(club) = lower('{CLUB}')
  ORDER BY total_goals DESC NULLS LAST, player_name LIMIT {serve.SQUAD_LIMIT}""",
    "served_clubs": f"SELECT player_name, club, coalesce(nullif(club, ''), '{serve.UNKNOWN_CLUB}') AS club_label, position FROM ({_PLAYERS})",
    "served_not_found": f"""
  SELECT 'team' AS what, count(*) AS rows FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'no team', 0
  UNION ALL SELECT 'profile', count(*) FROM ({_SCORING}) WHERE player_name = 'Plâyer 000000001'
  UNION ALL SELECT 'no profile', 0 UNION ALL SELECT 'no squad', 0""",
    "served_player_files": f"""
  SELECT player_name, club, position IS NOT NULL AS has_position, total_xg IS NOT NULL AS has_xg, total_goals IS NOT NULL AS has_goals
  FROM ({_PLAYERS})""",
    "served_results_file": f"""
  SELECT CAST(row_number() OVER (ORDER BY match_date DESC, home_team, away_team) - 1 AS INTEGER) AS place, *
  FROM ({_named(testbed.ORACLE_SQL["gold_recent_results"])})""",
    "served_upcoming": _named(testbed.ORACLE_SQL["gold_upcoming_fixtures"]),
    "served_tactics": f"""
  SELECT *, {testbed._r("goals_scored - expected_goals")} AS performance, CASE WHEN {testbed._r("goals_scored - expected_goals")} > 0 THEN 'over' ELSE 'under' END AS flag
  FROM ({_TACTICS})""",
    "served_scoring": _SCORING,
    "pipeline_player_matches": _SCORING.split(",\ntotals AS (")[0] + """
  SELECT player_name, match_date, position, minutes AS minutes_played, goals, assists, xg, xa FROM kept""",
}
