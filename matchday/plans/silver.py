"""Bronze documents -> typed silver tables (Q-STAND, Q-MATCH, Q-STATS, Q-FIX, Q-SEAS, Q-PM).

Builders are pure DataFrame -> DataFrame functions; `run_silver` reads the
bronze folders and merges each result into its snapshot table.

Decisions on the source's quirks (see SURVEY quirks):
* dates are parsed to `DateType`, so "recent" means chronological (Q1);
* every merge source is de-duplicated latest-wins on its merge key (Q2, Q3);
  a row whose key did not type (a date that does not parse) is kept as its own
  row rather than merged with others on a null key;
* standings keep expected goals as double; `truncate_xg=True` gives the
  source's integer truncation instead (Q4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.casts import parse_match_date, parse_timestamp, to_double, to_int, to_int_truncated
from ..operators import ledger
from ..operators.nested import cell, explode_records
from ..operators.reshape import flatten_roster
from ..operators.upsert import merge_into, merge_source, overwrite
from ..sources.documents import POSITION, read_documents, read_rows, split_broken
from ..session import materialize, stored
from ..sources.snapshots import newest_load
from ..sources.tables import optional_table
from .enrich import alias_groups, conform

STAMP = "meta.extraction_timestamp"


def _conformed(df: DataFrame, cols: tuple[str, ...], aliases: DataFrame | None) -> DataFrame:
    """Names in one spelling before any key is compared (Q7)."""
    return df if aliases is None else conform(df, cols, aliases)


def _stamp_cols():
    return [parse_timestamp(STAMP).alias("updated_at"), F.col("load_date")]


def league_standings(bronze: DataFrame, truncate_xg: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """League documents of any number of loads -> one row per team, newest load wins."""
    rows = explode_records(bronze, "data", "t", keep=[F.col(STAMP).alias("_ts"), "load_date"])
    d = F.col("t.Data")
    xg = to_int_truncated if truncate_xg else to_double
    typed = rows.select(
        F.col("t.Team").alias("team_name"),
        F.col("t.URL").alias("team_url"),
        to_int(cell(d, 0)).alias("rank"),
        to_int(cell(d, 3)).alias("matches_played"),
        to_int(cell(d, 4)).alias("wins"),
        to_int(cell(d, 5)).alias("draws"),
        to_int(cell(d, 6)).alias("losses"),
        to_int(cell(d, 7)).alias("goals_for"),
        to_int(cell(d, 8)).alias("goals_against"),
        to_int(cell(d, 9)).alias("points"),
        xg(cell(d, 10)).alias("xG_for"),
        xg(cell(d, 11)).alias("xG_against"),
        parse_timestamp("_ts").alias("updated_at"),
        F.col("load_date"))
    return merge_source(_conformed(typed, ("team_name",), aliases), schemas.KEYS["league_standings"], "load_date", ["updated_at"])


def team_matches(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Team documents -> one row per (team, date, opponent) result."""
    rows = explode_records(docs, "results", "m", keep=["team_name", "meta", "load_date"])
    typed = rows.select(
        "team_name",
        parse_match_date("m.date").alias("match_date"),
        F.col("m.opponent").alias("opponent"),
        F.col("m.side").alias("home_away"),
        F.col("m.result").alias("result_status"),
        to_int("m.team_score").alias("goals_scored"),
        to_int("m.opponent_score").alias("goals_conceded"),
        to_double("m.team_xg").alias("xg_for"),
        to_double("m.opponent_xg").alias("xg_against"),
        *_stamp_cols())
    return merge_source(_conformed(typed, ("team_name", "opponent"), aliases), schemas.KEYS["team_matches"], "load_date", ["updated_at"])


def team_statistics(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Team documents -> one row per (team, load, situation); stat fields stay text.
    Known fields are fixed columns, unknown ones land in `extra` (PRJ5)."""
    rows = explode_records(docs, "statistics", "stat", keep=["team_name", "meta", "load_date"])
    known = [F.col("stat")[f].alias(f) for f in schemas.STAT_FIELDS]
    extra = F.map_filter("stat", lambda k, v: ~k.isin(*schemas.STAT_FIELDS))
    typed = rows.select("team_name", *known, extra.alias("extra"), *_stamp_cols())
    return merge_source(_conformed(typed, ("team_name",), aliases), schemas.KEYS["team_statistics"], "updated_at")


def team_fixtures(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Team documents -> upcoming fixtures, one per (team, date, opponent)."""
    rows = explode_records(docs, "fixtures", "f", keep=["team_name", "meta", "load_date"])
    typed = rows.select(
        "team_name",
        parse_match_date("f.date").alias("fixture_date"),
        F.col("f.time").alias("fixture_time"),
        F.col("f.opponent").alias("opponent"),
        F.col("f.side").alias("home_away"),
        *_stamp_cols())
    return merge_source(_conformed(typed, ("team_name", "opponent"), aliases), schemas.KEYS["team_fixtures"], "load_date", ["updated_at"])


def team_rosters(docs: DataFrame) -> DataFrame:
    """(player, url, team) for roster entries with a URL (ING6)."""
    return flatten_roster(docs, "team_name", "roster")


def player_seasons(docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Player documents -> season rows; the blank totals row is dropped (FLT1)."""
    rows = explode_records(docs, "seasonal_performance", "s",
                           keep=["player_name", "player_url", "meta", "load_date"])
    typed = rows.filter(F.col("s.Season") != "").select(
        "player_name", "player_url",
        F.col("s.Season").alias("season_year"),
        F.col("s.Team").alias("team_name"),
        to_int("s.Apps").alias("appearances"),
        to_int("s.Min").alias("minutes_played"),
        to_int("s.G").alias("goals"),
        to_int("s.A").alias("assists"),
        to_double("s.Sh90").alias("shots_per_90"),
        to_double("s.KP90").alias("key_passes_per_90"),
        to_double("s.xG").alias("xg"),
        to_double("s.xA").alias("xa"),
        *_stamp_cols())
    return merge_source(_conformed(typed, ("team_name",), aliases), schemas.KEYS["player_seasons"], "load_date", ["updated_at"])


def player_matches(docs: DataFrame) -> DataFrame:
    """Player documents -> match rows, one per (player, date) (Q2: de-duplicated on every path)."""
    rows = explode_records(docs, "match_performance", "m",
                           keep=["player_name", "player_url", "meta", "load_date"])
    typed = rows.filter(F.col("m.Date") != "").select(
        "player_name", "player_url",
        parse_match_date("m.Date").alias("match_date"),
        F.col("m.Home").alias("home_team"),
        F.col("m.Away").alias("away_team"),
        F.col("m.Score").alias("score"),
        F.col("m.Pos").alias("position"),
        to_int("m.Min").alias("minutes_played"),
        to_int("m.Sh").alias("shots"),
        to_int("m.G").alias("goals"),
        to_int("m.KP").alias("key_passes"),
        to_int("m.A").alias("assists"),
        to_double("m.xG").alias("xg"),
        to_double("m.xA").alias("xa"),
        *_stamp_cols())
    return merge_source(typed, schemas.KEYS["player_matches"], "load_date", ["updated_at", "player_url"])


PARTS = ("league", "teams", "players")
ALIASES = "aliases"          # bronze folder of {name, canonical} arrays, optional
QUARANTINE = "quarantine"    # silver table of the documents that didn't parse


def read_aliases(spark: SparkSession, bronze_root: str, glob: str | None = "*.json") -> DataFrame | None:
    """The alias table from `<bronze>/aliases`, connected groups of its pairs; None without such a folder."""
    rows = optional_table(lambda: read_rows(spark, f"{bronze_root.rstrip('/')}/{ALIASES}", schemas.ALIASES, glob))
    if rows is None:
        return None
    preferred = rows.select(F.col("canonical").alias("name"), POSITION)
    return materialize(alias_groups(rows.select(F.col("name").alias("a"), F.col("canonical").alias("b")), preferred))


def run_silver(spark: SparkSession, bronze_root: str, silver_root: str,
               parts: tuple[str, ...] = PARTS, multiline: bool = True, glob: str | None = "*.json",
               only_new: bool = False) -> dict[str, int]:
    """Read bronze, build the silver tables of `parts` and merge each into
    `<silver_root>/<table>`. Returns the snapshot version written per table.

    Teams and players use the newest load only; standings read every load and
    keep the newest per team. A requested part whose source is missing raises
    `NoSnapshotError` (nothing is skipped silently). A document that doesn't parse
    goes to the table `quarantine`, one row per file and text. Names of teams are
    conformed by `<bronze>/aliases`, if there is such a folder (Q7). `multiline=False` reads
    JSON Lines, as `export.write_bronze` writes them, instead of one document a file.
    The loads of each part are noted in `<silver_root>/loads` (`operators.ledger`);
    `only_new` leaves out the parts whose loads were merged already as they are.
    """
    b, s = bronze_root.rstrip("/"), silver_root.rstrip("/")
    out: dict[str, int] = {}
    aliases = read_aliases(spark, b, glob)

    found = {p: ledger.marks(spark, b, p, newest=p != "league") for p in parts}     # listed before anything is read
    if only_new:
        parts = tuple(p for p in parts if not ledger.all_merged(spark, s, found[p]))

    def whole(part: str, schema, newest: bool) -> DataFrame:
        """The part's documents, parsed once and stored; those that don't parse go to the quarantine table."""
        load = newest_load(spark, f"{b}/{part}")
        docs = read_documents(spark, f"{b}/{part}", schema, glob=glob, multiline=multiline, broken="keep")
        if newest:
            docs = docs.filter(F.col("load_date") == F.lit(load).cast("date"))
        good, bad = split_broken(stored(docs, f"documents-{part}"))
        bad = bad.withColumn("part", F.lit(part))
        if not bad.isEmpty():
            out[QUARANTINE] = merge_into(spark, f"{s}/{QUARANTINE}", bad, schemas.KEYS[QUARANTINE], "load_date")
        return good
    if "league" in parts:
        league = whole("league", schemas.LEAGUE_DOC, newest=False)
        out["league_standings"] = merge_into(spark, f"{s}/league_standings", league_standings(league, aliases=aliases),
                                             schemas.KEYS["league_standings"], "load_date", ["updated_at"], latest=True)
        ledger.record(spark, s, found["league"])
    if "teams" in parts:
        teams = whole("teams", schemas.TEAM_DOC, newest=True)
        out["team_matches"] = merge_into(spark, f"{s}/team_matches", team_matches(teams, aliases),
                                         schemas.KEYS["team_matches"], "load_date", ["updated_at"], latest=True)
        out["team_statistics"] = merge_into(spark, f"{s}/team_statistics", team_statistics(teams, aliases),
                                            schemas.KEYS["team_statistics"], "updated_at", latest=True)
        # fixtures move between loads: replace the schedule instead of merging it
        out["team_fixtures"] = overwrite(spark, team_fixtures(teams, aliases), f"{s}/team_fixtures")
        ledger.record(spark, s, found["teams"])
    if "players" in parts:
        players = whole("players", schemas.PLAYER_DOC, newest=True)
        out["player_seasons"] = merge_into(spark, f"{s}/player_seasons", player_seasons(players, aliases),
                                           schemas.KEYS["player_seasons"], "load_date", ["updated_at"], latest=True)
        out["player_matches"] = merge_into(spark, f"{s}/player_matches", player_matches(players),
                                           schemas.KEYS["player_matches"], "load_date", ["updated_at", "player_url"], latest=True)
        ledger.record(spark, s, found["players"])
    return out
