"""Silver -> gold marts (Q-PLAY, Q-SUM, Q-TREND, Q-TAC, Q-REC, Q-UP).

Each mart is computed once and written once; the JSON export reads the
written snapshot instead of re-running the plan (the source ran every mart
twice: once to write, once to collect to the driver).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.casts import to_double, to_int
from ..functions.metrics import difference
from ..functions.text import name_lookup_key
from ..operators.aggregates import scoring_totals
from ..operators.buckets import BUCKETS, merge_buckets, read_buckets
from ..operators.export import export_json, export_json_array
from ..operators.joins import left_enrich
from ..operators.ranking import first_per_key, ordered_array, top_k
from ..operators.resolve import RATIO_CUTOFF
from ..operators.upsert import overwrite, read_latest, write_lookup
from ..session import materialize
from ..sources.documents import read_rows
from ..sources.snapshots import latest_per_key
from ..sources.tables import optional_table
from .enrich import enrich_players, enrich_teams

# Fixed values of the marts.
SEASON_START = "2025-08-01"
FORM_LENGTH = 5
LIST_LENGTH = 20
NO_FIXTURE_OPPONENT = "TBD"
NO_FIXTURE_SIDE = "h"


def player_scoring_stats(player_matches: DataFrame, season_start: str = SEASON_START,
                         min_minutes: int = 0) -> DataFrame:
    """Per player, current season: matches, minutes, goals, assists, xG, xA, goals - xG.
    Players with `min_minutes` minutes or fewer are left out (the source: 0; Q8)."""
    season = player_matches.filter(F.col("match_date") >= F.lit(season_start).cast("date"))
    totals = scoring_totals(season, "player_name", "match_date", "minutes_played", "goals", "assists", "xg", "xa",
                            min_total_minutes=min_minutes)
    # one row per player: the range sort is over the aggregate, not the matches (ORD1)
    return totals.orderBy(F.col("total_goals").desc_nulls_last(), F.col("player_name").asc())


def refresh_player_scoring(spark: SparkSession, matches_path: str, mart_path: str, load: DataFrame,
                           season_start: str = SEASON_START, buckets: int = BUCKETS) -> tuple[int, int]:
    """Merge `load` (typed match rows) into the bucketed matches and bring the scoring mart up to date.

    Both tables are bucketed by player. Only buckets that hold the load's players
    are read and written, and only these players are added up again; a player who
    no longer has a row in the mart leaves it. Rows without a player name are
    merged, but not counted. Returns the snapshots written.
    """
    by = ["player_name"]
    changed = materialize(load.filter("player_name is not null").select(*by).distinct())
    first = merge_buckets(spark, matches_path, load, schemas.KEYS["player_matches"], "load_date", ["updated_at", "player_url"],
                          buckets, bucket_by=by)
    rows = read_buckets(spark, matches_path, by, changed).join(changed, by, "left_semi")
    mart = player_scoring_stats(rows, season_start)
    return first, merge_buckets(spark, mart_path, mart, by, "total_minutes", buckets=buckets, replace=changed)


def team_form(matches: DataFrame, k: int = FORM_LENGTH) -> DataFrame:
    """Per team, the last k results newest first: `form_array` of W/D/L (WIN2, AGG6, SC1)."""
    played = matches.filter(F.col("result_status").isNotNull())
    return ordered_array(played, "team_name",
                         [F.col("match_date").desc_nulls_last(), F.col("opponent").asc()],
                         F.upper("result_status"), k, "form_array")


def next_fixtures(fixtures: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per team, the first fixture on or after `as_of` (WIN1, FLT6, Q15)."""
    f = fixtures
    if as_of is not None:
        f = f.filter(F.col("fixture_date") >= F.lit(as_of).cast("date"))
    first = first_per_key(f, "team_name", [F.col("fixture_date").asc_nulls_last(),
                                          F.col("fixture_time").asc_nulls_last(), F.col("opponent").asc()])
    return first.select("team_name", F.col("opponent").alias("next_opponent"),
                        F.col("home_away").alias("next_home_away"))


def team_summary(standings: DataFrame, matches: DataFrame, fixtures: DataFrame | None,
                 as_of: str | None = None, check_unique: bool = False) -> DataFrame:
    """Standings + last-five form + next fixture, ordered by rank (JN1, JN2, PRJ11, SRC7, ORD1)."""
    form = team_form(matches)
    if fixtures is None:
        nxt = standings.select("team_name", F.lit(NO_FIXTURE_OPPONENT).alias("next_opponent"),
                               F.lit(NO_FIXTURE_SIDE).alias("next_home_away"))
    else:
        nxt = next_fixtures(fixtures, as_of)
    s = standings.select("rank", "team_name", "matches_played", "wins", "draws", "losses", "points",
                         "goals_for", "goals_against")
    out = left_enrich(left_enrich(s, form, ["team_name"], check_unique), nxt, ["team_name"], check_unique)
    return (out.withColumn("goal_difference", difference("goals_for", "goals_against", None))
            .select("rank", "team_name", "matches_played", "wins", "draws", "losses", "points", "goals_for",
                    "goals_against", "goal_difference", "form_array", "next_opponent", "next_home_away")
            .orderBy(F.col("rank").asc_nulls_last(), F.col("team_name").asc()))


def team_match_trends(matches: DataFrame) -> DataFrame:
    """Per-team chronological match list, newest first (PRJ12, ORD2)."""
    return (matches.select("team_name", "match_date", "opponent", "home_away", "result_status",
                           "goals_scored", "goals_conceded", "xg_for", "xg_against")
            .orderBy(F.col("team_name").asc(), F.col("match_date").desc_nulls_last(), F.col("opponent").asc()))


def team_tactics(statistics: DataFrame) -> DataFrame:
    """Goals, xG and shots per play type from the newest load per team (FLT2, PRJ6, PRJ7, Q5)."""
    latest = latest_per_key(statistics.filter(F.col("Situation").isNotNull()), ["team_name", "Situation"])
    return (latest.select(
        "team_name", F.col("Situation").alias("play_type"),
        to_int("G").alias("goals_scored"),
        to_double("xG").alias("expected_goals"),
        to_int("Sh").alias("total_shots"),
        to_double("`xG/Sh`").alias("xg_per_shot"))
        .orderBy(F.col("team_name").asc(), F.col("goals_scored").desc_nulls_last(), F.col("play_type").asc()))


def recent_results(matches: DataFrame, k: int = LIST_LENGTH) -> DataFrame:
    """League-wide latest k results, home rows only (FLT4, ORD3)."""
    home = matches.filter(F.col("home_away") == "h").select(
        "match_date", F.col("team_name").alias("home_team"), F.col("goals_scored").alias("home_goals"),
        F.col("goals_conceded").alias("away_goals"), F.col("opponent").alias("away_team"))
    return top_k(home, [F.col("match_date").desc_nulls_last(), F.col("home_team").asc(),
                        F.col("away_team").asc()], k)


def upcoming_fixtures(fixtures: DataFrame, k: int = LIST_LENGTH, as_of: str | None = None) -> DataFrame:
    """League-wide next k fixtures, home rows only (FLT4, ORD3)."""
    f = fixtures.filter(F.col("home_away") == "h")
    if as_of is not None:
        f = f.filter(F.col("fixture_date") >= F.lit(as_of).cast("date"))
    out = f.select("fixture_date", "fixture_time", F.col("team_name").alias("home_team"),
                   F.col("opponent").alias("away_team"))
    return top_k(out, [F.col("fixture_date").asc_nulls_last(), F.col("fixture_time").asc_nulls_last(),
                       F.col("home_team").asc(), F.col("away_team").asc()], k)


def enriched(spark: SparkSession, bronze_root: str, mart: str, base: DataFrame, glob: str | None = "*.json",
             cutoff: float | None = RATIO_CUTOFF) -> DataFrame | None:
    """`base` with the columns of `<bronze>/profiles` or `<bronze>/badges` (Q-ENR); None without such a folder."""
    folder, schema, add = ENRICHED[mart]
    right = optional_table(lambda: read_rows(spark, f"{bronze_root.rstrip('/')}/{folder}", schema, glob))
    return None if right is None else add(base, right, cutoff=cutoff)


# mart -> (bronze folder of JSON arrays, its schema, how it is added)
ENRICHED = {"enriched_players": ("profiles", schemas.PROFILES, enrich_players),
            "enriched_teams": ("badges", schemas.BADGES, enrich_teams)}
PLAYERS_BY_NAME = "players_by_name"      # the players again, sorted by name, for profile lookups
ENRICHED_FROM = {"enriched_players": "player_scoring_stats", "enriched_teams": "team_summary"}

MARTS = ("player_scoring_stats", "team_summary", "team_match_trends", "team_tactics",
         "league_recent_results", "league_upcoming_fixtures")
# exported as one JSON array each, in this order: their first LIST_LENGTH rows
ARRAY_EXPORTS = {
    "league_recent_results": lambda: [F.col("match_date").desc_nulls_last(), F.col("home_team").asc(),
                                      F.col("away_team").asc()],
    "league_upcoming_fixtures": lambda: [F.col("fixture_date").asc_nulls_last(), F.col("fixture_time").asc_nulls_last(),
                                         F.col("home_team").asc(), F.col("away_team").asc()],
}


def run_gold(spark: SparkSession, silver_root: str, gold_root: str, export_root: str | None = None,
             season_start: str = SEASON_START, as_of: str | dt.date | None = None,
             marts: tuple[str, ...] = MARTS, bronze_root: str | None = None,
             glob: str | None = "*.json", cutoff: float | None = RATIO_CUTOFF) -> dict[str, int]:
    """Build, write and (optionally) export the requested marts. Returns versions written.

    The league's upcoming fixtures are skipped when there is no fixtures table
    (as the source does); any other missing input raises. With `bronze_root`, the
    players' and teams' marts are also written enriched, from the lists of profiles
    and badges that lie there (a list that doesn't exist is skipped), and the players
    once more, sorted by name for lookups. `glob` selects the lists' files; `cutoff=None` leaves out the ratio rule of names.
    """
    s, g = silver_root.rstrip("/"), gold_root.rstrip("/")
    as_of = as_of.isoformat() if isinstance(as_of, dt.date) else as_of

    def silver_table(name: str) -> DataFrame:
        return read_latest(spark, f"{s}/{name}")

    fixtures = optional_table(lambda: silver_table("team_fixtures"))
    builders = {
        "player_scoring_stats": lambda: player_scoring_stats(silver_table("player_matches"), season_start),
        "team_summary": lambda: team_summary(silver_table("league_standings"), silver_table("team_matches"),
                                             fixtures, as_of),
        "team_match_trends": lambda: team_match_trends(silver_table("team_matches")),
        "team_tactics": lambda: team_tactics(silver_table("team_statistics")),
        "league_recent_results": lambda: recent_results(silver_table("team_matches")),
        "league_upcoming_fixtures": lambda: upcoming_fixtures(fixtures, as_of=as_of),
    }
    versions: dict[str, int] = {}
    for name in marts:
        if name == "league_upcoming_fixtures" and fixtures is None:
            continue
        versions[name] = overwrite(spark, builders[name](), f"{g}/{name}")
    for name, base in ENRICHED_FROM.items():
        if bronze_root and base in versions:
            mart = enriched(spark, bronze_root, name, read_latest(spark, f"{g}/{base}"), glob, cutoff)
            if mart is not None:
                versions[name] = overwrite(spark, mart, f"{g}/{name}")
    if bronze_root and "player_scoring_stats" in versions:
        players = read_latest(spark, f"{g}/{'enriched_players' if 'enriched_players' in versions else 'player_scoring_stats'}")
        versions[PLAYERS_BY_NAME] = write_lookup(spark, players, f"{g}/{PLAYERS_BY_NAME}", name_lookup_key("player_name"))
    if export_root:
        for name in versions:
            if name == PLAYERS_BY_NAME:
                continue
            mart = read_latest(spark, f"{g}/{name}")
            target = f"{export_root.rstrip('/')}/{name}"
            if name in ARRAY_EXPORTS:
                export_json_array(mart, target, ARRAY_EXPORTS[name](), LIST_LENGTH)
            else:
                export_json(mart, target)
    return versions
