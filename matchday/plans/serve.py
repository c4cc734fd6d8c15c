"""Parameterised mart queries that the API and the dashboard ran in JavaScript
over whole files (Q-API1-4, Q-UI1-6), as Spark queries over the marts.

"Not found" is an empty DataFrame; callers test `df.isEmpty()` (FLT11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..functions.casts import format_match_date
from ..operators import joins, ranking
from ..operators.aggregates import top_by
from ..operators.upsert import lookup, read_latest
from .gold import PLAYERS_BY_NAME

# Fixed values of the UI.
LEADERS_LIMIT = 10
SQUAD_LIMIT = 6
SIMILAR_LIMIT = 8
LAST_MATCHES = 3
UNKNOWN_CLUB = "Unknown Club"


def whole_mart(spark: SparkSession, gold_root: str, name: str) -> DataFrame:
    """Q-API1: a whole mart."""
    return read_latest(spark, f"{gold_root.rstrip('/')}/{name}")


def for_team(df: DataFrame, team: str, col: str = "team_name") -> DataFrame:
    """Q-API2: rows of one team, case-insensitive; a null name never matches (FLT7)."""
    c = F.col(col)
    return df.filter(c.isNotNull() & (F.lower(c) == team.lower()))


def default_row(df: DataFrame, order_col: str = "rank", tiebreak: str = "team_name") -> DataFrame:
    """ORD8: the first row by rank (the team selected when none is chosen)."""
    return ranking.top_k(df, [F.col(order_col).asc_nulls_last(), F.col(tiebreak).asc()], 1)


def team_players(players: DataFrame, team: str) -> DataFrame:
    """Q-API2: the players whose club equals `team`, case-insensitive (FLT7)."""
    return for_team(players, team, "club")


def player_profile(players: DataFrame, slug: str) -> DataFrame:
    """Q-API3: the player whose lower-cased name equals the slug with `-` as space (FLT8)."""
    hit = players.filter(F.lower("player_name") == text.slug_to_name(slug))
    return ranking.top_k(hit, [F.col("player_name").asc()], 1)


def profile(spark: SparkSession, gold_root: str, slug: str) -> DataFrame:
    """Q-API3 over the written lookup mart: only row groups that may hold the name are read (FLT8).
    Of players with one name the first by all columns; nobody is an empty result (FLT11)."""
    hit = lookup(spark, f"{gold_root.rstrip('/')}/{PLAYERS_BY_NAME}", text.slug_to_name(slug))
    return ranking.top_k(hit, [F.col(f"`{f.name}`").asc_nulls_last() for f in hit.schema.fields], 1)


def leaders_of_all(players: DataFrame, measures: list[str], k: int = LEADERS_LIMIT) -> DataFrame:
    """Q-API4 for every measure of the front page at once: one scan of the mart (ORD4)."""
    return ranking.leaders_of_all(players, measures, "player_name", k)


def leaders(players: DataFrame, stat: str, k: int = LEADERS_LIMIT) -> DataFrame:
    """Q-API4: top k players by any numeric measure, nulls out, ranked 1..k (ORD4, WIN3)."""
    return ranking.leaders(players, stat, "player_name", k)


def league_table(summary: DataFrame, badges: DataFrame | None = None) -> DataFrame:
    """Q-UI1: summary + zone + short code + badge of the team and of the next opponent (SC14, SC9, JN4)."""
    n_teams = summary.count()  # one scalar, partial-aggregated
    out = (summary.withColumn("zone", metrics.zone("rank", F.lit(n_teams)))
           .withColumn("code", text.code3("team_name")))
    if badges is not None:
        out = joins.lookup(out, badges, "team_name", "team", "team_", ["badge_url"])
        out = joins.lookup(out, badges, "next_opponent", "team", "opponent_", ["badge_url"])
    return out


def last_matches(trends: DataFrame, team: str, k: int = LAST_MATCHES) -> DataFrame:
    """Q-UI2: a team's last k played matches, oldest first (WIN4, ORD6, Q13)."""
    played = for_team(trends, team).filter(F.col("result_status").isNotNull())
    return ranking.last_k_oldest_first(played, "team_name", "match_date", "opponent", k, "pos").orderBy("pos")


def timeline(trends: DataFrame, team: str) -> DataFrame:
    """Q-UI2: a team's played matches in chronological order, with outcome and side labels."""
    played = for_team(trends, team).filter(F.col("result_status").isNotNull())
    return (played.withColumn("outcome", metrics.outcome("goals_scored", "goals_conceded"))
            .withColumn("side", metrics.side_label("home_away"))
            .orderBy(F.col("match_date").asc(), F.col("opponent").asc()))


def squad(players: DataFrame, team: str, sort_key: str = "total_goals", direction: str = "desc",
          k: int = SQUAD_LIMIT) -> DataFrame:
    """Q-UI2: a club's players sorted by a chosen column, first k (FLT7, ORD5)."""
    return ranking.sort_by_choice(team_players(players, team), sort_key, direction, "player_name", k)


def player_metrics(players: DataFrame) -> DataFrame:
    """Q-UI3: per-90 rates and capped progress percentages (SC12, SC13, SC3)."""
    return players.select(
        "*",
        metrics.per90("total_goals", "total_minutes").alias("goals_per90"),
        metrics.per90("total_assists", "total_minutes").alias("assists_per90"),
        metrics.capped_percent("total_goals").alias("goals_pct"),
        metrics.capped_percent("total_xg").alias("xg_pct"),
        metrics.capped_percent("total_assists").alias("assists_pct"),
        metrics.capped_percent("total_xa").alias("xa_pct"))


def similar_players(team_players: DataFrame, player: str, k: int = SIMILAR_LIMIT,
                    file_order: str = "_order") -> DataFrame:
    """Q-UI4: same position first (in list order), then others A-Z, self excluded, k rows (FLT10, SET2)."""
    df = team_players if file_order in team_players.columns else team_players.withColumn(
        file_order, F.monotonically_increasing_id())
    me = df.filter(F.col("player_name") == player).orderBy(file_order).select("position").first()
    pos = me["position"] if me else None
    return ranking.same_group_first(df, "position", pos, "player_name", player, file_order, "player_name", k)


def top_scorer(players: DataFrame, team_col: str = "club") -> DataFrame:
    """Per team, the player with the most goals (AGG7); ties go to the first name A-Z."""
    return top_by(players, team_col, "player_name", "total_goals", "player_name", "top_scorer")


def is_member(players: DataFrame, team: str, player: str) -> bool:
    """JN8: is the selected player in this team's list? Reads at most one row."""
    return not for_team(players, team, "club").filter(F.col("player_name") == player).limit(1).isEmpty()


def season_rates(seasons: DataFrame, min_minutes: int = 0) -> DataFrame:
    """Season rows with their per-90 rates, optionally only above a minute floor:
    the rates are kept as scraped, and a 2-minute cameo shows 45 shots per 90 (Q8)."""
    return seasons.filter(F.col("minutes_played") >= min_minutes).select(
        "player_name", "season_year", "team_name", "minutes_played", "shots_per_90", "key_passes_per_90",
        metrics.per90("goals", "minutes_played").alias("goals_per90"))


def tactics_performance(tactics: DataFrame) -> DataFrame:
    """Q-UI5: goals - xG per play type and its sign (PRJ11, SC16)."""
    return (tactics.withColumn("performance", metrics.difference("goals_scored", "expected_goals", 2))
            .withColumn("flag", metrics.sign_flag("performance")))


def trend_series(trends: DataFrame, team: str) -> DataFrame:
    """Q-UI6: xG for / against by date with short date and side labels (SC10, SC18)."""
    return (for_team(trends, team)
            .select("match_date", text.first_part(format_match_date("match_date")).alias("date_label"),
                    "opponent", metrics.side_label("home_away").alias("side"),
                    F.coalesce("xg_for", F.lit(0.0)).alias("xg_for"),
                    F.coalesce("xg_against", F.lit(0.0)).alias("xg_against"))
            .orderBy("match_date"))


def club_label(players: DataFrame) -> DataFrame:
    """SC17: team name, else club, else a fixed label (empty text counts as missing)."""
    cols = [c for c in ("team_name", "club") if c in players.columns]
    return players.withColumn("club_label", metrics.first_present(*cols, default=UNKNOWN_CLUB))
