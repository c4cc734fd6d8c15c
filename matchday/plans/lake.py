"""The whole path on the driver's tables: documents -> bronze -> silver -> gold -> read.

Two loads of team and player documents are made from `orders` and `lineitem`,
written as JSON into a fresh folder of the shared location, and taken through
`run_silver` (once per load, so that the second one merges) and `run_gold`.
A *team* is a customer, a *player* a supplier. The first load has all of them; the
second has those whose key isn't divisible by three again, with one goal more in
every match, and matches that the first one lacks, so rows are inserted, replaced and
kept. Documents hold blank totals rows, blank numbers, null statuses, a statistics
field that no schema names, and every 50th team comes with a document that is cut off.

League documents are files of their own, over many lines, one for each region; a
team there is a nation. Nations are spelled in two ways (`FRANCE`, `Équipe
France`), which the alias list conforms; badges and profiles are JSON arrays.

Each lake is built once per session and folder of tables; the queries share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.export import stamp, write_bronze
from ..operators import ledger
from ..operators.upsert import overwrite, read_latest
from ..session import materialize, shared_dir
from ..sources.documents import read_documents, read_rows
from ..sources.tables import read_table, register_view
from . import enrich, gold, silver, testbed

AS_OF = "2000-01-01"     # matches before it have a status
PER_DOCUMENT = 10_000    # results of a team document, about, at most
LOADS = (("2024-05-01", 0), ("2024-05-08", 1))
RERUN_COLUMNS = ("team_name", "match_date", "opponent", "home_away", "result_status", "goals_scored", "goals_conceded", "load_date")


PROFILE_LISTS = 8        # files of profiles
BROKEN = 50              # every so many teams a cut-off document


def _in_load(key, load: int):
    """Every key is in the first load, some are in the second again."""
    return F.lit(True) if load == 0 else key % 3 != 0


def _documents(df: DataFrame, date: str) -> DataFrame:
    return stamp(df, f"{date} 09:00:00", date, "tables").withColumn("load_date", F.lit(date))


def _fields(names, values: dict):
    return F.struct(*[values.get(n, F.lit("")).cast("string").alias(n) for n in names])


UNDATED = 13             # every so many matches of `pipeline_rerun` has no date that parses


def team_documents(spark: SparkSession, sf_dir: str, date: str, load: int, undated: int = 0) -> DataFrame:
    """Team documents of a load; every `undated`-th match has a text instead of its date (0: none)."""
    o = read_table(spark, sf_dir, "orders").filter(_in_load(F.col("o_custkey"), load))
    raw = ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")

    def result(o):
        key, goals, day = o["o_orderkey"], F.floor(o["o_totalprice"] / 50_000) + load, F.date_format(o["o_orderdate"], "MMM d, yyyy")
        return _fields(schemas.RESULT_FIELDS, {
            "date": F.when(key % undated == 0, "postponed").otherwise(day) if undated else day, "opponent": o["o_orderpriority"],
            "side": F.when(key % 2 == 0, "h").otherwise("a"),
            # no status: the field is left out of the document
            "result": F.when(o["o_orderdate"] < F.lit(AS_OF).cast("timestamp_ntz"), F.lower(o["o_orderstatus"])),
            "team_score": goals.cast("string"), "opponent_score": (key % 5).cast("string"),
            # blank for every seventh
            "team_xg": F.when(key % 7 == 0, "").otherwise((key % 100 / 4).cast("string"))})
    stat = F.create_map(*[x for f, v in {
        "№": F.lit("1"), "Situation": F.col("o_orderstatus"), "Sh": F.col("n").cast("string"), "G": (F.col("n") + load).cast("string"),
        "xG": F.lit(""), "Clearances": (F.col("n") * 2).cast("string")}.items() for x in (F.lit(f), v)])
    stats = o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(
        F.collect_list(stat).alias("statistics"))
    # several documents for a team with very many orders, so that it is no single row; one more holds its statistics
    hot = o.groupBy(F.col("o_custkey").alias("hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_DOCUMENT).select(
        "hot", (F.ceil(F.col("n") / PER_DOCUMENT) * 3).alias("parts"))
    part = F.pmod(F.xxhash64("o_orderkey", "o_totalprice"), F.coalesce("parts", F.lit(1))).alias("part")
    # a row of `hot` for so many orders at least
    results = o.join(F.broadcast(hot), F.col("o_custkey").eqNullSafe(F.col("hot")), "left").groupBy("o_custkey", part).agg(
        F.collect_list(F.struct(*raw)).alias("raw")).select("o_custkey", F.transform("raw", result).alias("results"))    # texts come last: they are wide
    docs = results.select("o_custkey", "results", F.array().cast(stats.schema["statistics"].dataType).alias("statistics")).union(
        stats.select("o_custkey", F.array().cast(results.schema["results"].dataType), "statistics"))
    return _documents(docs.select(F.col("o_custkey").cast("string").alias("team_name"), "results", "statistics"), date)


def player_documents(spark: SparkSession, sf_dir: str, date: str, load: int) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(_in_load(F.col("l_suppkey"), load))
    years = li.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(
        F.count(F.lit(1)).alias("apps"), F.sum("l_quantity").cast("long").alias("minutes"))
    season = _fields(schemas.SEASON_FIELDS, {"Season": F.col("y").cast("string"), "Team": F.concat(F.lit("club "), F.col("l_suppkey")),
                                             "Apps": F.col("apps") + load, "Min": F.col("minutes"), "xG": F.lit("")})
    totals = _fields(schemas.SEASON_FIELDS, {"Apps": F.sum("apps"), "Min": F.sum("minutes")})     # no season
    docs = years.groupBy("l_suppkey").agg(F.array_append(F.collect_list(season), totals).alias("seasonal_performance"))
    return _documents(docs.select(F.concat(F.lit("player "), F.col("l_suppkey")).alias("player_name"),
                                  F.concat(F.lit("/p/"), F.col("l_suppkey")).alias("player_url"),
                                  "seasonal_performance"), date)


def cut_off(docs: DataFrame) -> DataFrame:
    """The first half of the text of every 50th team's document."""
    text = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "load_date"]))
    some = docs.filter((F.col("team_name").cast("long") % BROKEN == 0) & (F.size("statistics") > 0))
    return some.select(F.substring(text, F.lit(1), (F.length(text) / 2).cast("int")).alias("value"), "load_date")


def league_documents(spark: SparkSession, sf_dir: str, load: int) -> DataFrame:
    """(r_name, document): a league table per region, as text over many lines; at most 25 teams in all."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    o = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(      # customers are joined to sums, not to orders
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("w"),
        F.count_if(F.col("o_orderstatus") == "O").alias("d"))
    # as many sums as customers: they are joined where they lie, not sent to the driver
    c = read_table(spark, sf_dir, "customer").join(o.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(
        *[F.sum(x).alias(x) for x in ("n", "w", "d")])
    t = nation.join(c, nation.n_nationkey == c.c_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Équipe "), F.initcap("n_name"))).otherwise(F.col("n_name"))
    cells = ["n_nationkey", name, F.lit("u"), "n", F.col("w") + load, "d", F.col("n") - F.col("w") - F.col("d"), F.col("n") * 2, "w",
             F.col("w") * 3 + F.col("d"), F.concat(F.col("n_nationkey"), F.lit(".75")), F.lit("")]
    data = F.array(*[(F.col(x) if isinstance(x, str) else x).cast("string") for x in cells])
    row = F.struct(name.alias("Team"), F.lit("u").alias("URL"), data.alias("Data"))
    docs = t.groupBy("r_name").agg(F.sort_array(F.collect_list(row)).alias("data"))
    date = LOADS[load][0]
    return stamp(docs, f"{date} 09:00:00", date, "tables").select(
        "r_name", F.to_json(F.struct("data", "_metadata"), {"pretty": "true"}).alias("value"))


def _write_text(df: DataFrame, path: str) -> None:
    """One file per row of `df(name, value)`: small sets of documents as they lie on disk. `df` is computed once."""
    df = materialize(df)
    for r in df.select(df.columns[0]).distinct().collect():
        one = df.filter(F.col(df.columns[0]) == r[0]).select("value").coalesce(1)
        one.write.mode("append").option("lineSep", "\n").text(path)


def _league(spark: SparkSession, sf_dir: str, root: str) -> None:
    nation = read_table(spark, sf_dir, "nation")
    upper, other = F.initcap("n_name"), F.concat(F.lit("Équipe "), F.initcap("n_name"))

    def array(rows, path):
        """One JSON array, in the order of the nations' keys."""
        rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "r"))), lambda x: x["r"])).alias("value")) \
            .coalesce(1).write.text(path)
    array(nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), upper.alias("canonical")).alias("r")).union(
        nation.select("n_nationkey", F.struct(other.alias("name"), F.col("n_name").alias("canonical")).alias("r"))),
        f"{root}/bronze/{silver.ALIASES}")
    badge = F.struct(F.concat(F.lit("The "), F.upper("n_name"), F.lit(" FC")).alias("team"),
                     F.concat(F.lit("b/"), F.col("n_nationkey"), F.lit(".png")).alias("badge_url"))
    array(nation.filter("n_nationkey % 5 != 4").select("n_nationkey", badge.alias("r")), f"{root}/bronze/badges")
    for load, (date, _) in enumerate(LOADS):
        _write_text(league_documents(spark, sf_dir, load), f"{root}/bronze/league/load_date={date}")
    (spark.range(1).select(F.lit('{"data": [{"Team": "Nobody"').alias("value")).coalesce(1)
     .write.mode("append").text(f"{root}/bronze/league/load_date={LOADS[1][0]}"))
    silver.run_silver(spark, f"{root}/bronze", f"{root}/silver", ("league",), glob=None)


def _reruns(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One load merged three times over, in part without keys; another one lies there and isn't merged yet."""
    (date, load), (later, after) = LOADS
    write_bronze(team_documents(spark, sf_dir, date, load, UNDATED), f"{root}/bronze/teams", "gzip")
    for only_new in (False, False, True):
        silver.run_silver(spark, f"{root}/bronze", f"{root}/silver", ("teams",), multiline=False, glob=None, only_new=only_new)
    write_bronze(team_documents(spark, sf_dir, later, after), f"{root}/bronze/teams", "gzip")


_BUILT: dict[tuple, str] = {}


def build(spark: SparkSession, sf_dir: str, part: str) -> str:
    """Write and load both loads of `part` (league, teams or players), or the reruns; the lake's folder."""
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key in _BUILT:
        return _BUILT[key]
    root = shared_dir(spark, f"lake-{part}")
    if part == "league":
        _league(spark, sf_dir, root)
    elif part == "reruns":
        _reruns(spark, sf_dir, root)
    else:
        make = {"teams": team_documents, "players": player_documents}[part]
        for date, load in LOADS:
            docs = make(spark, sf_dir, date, load)
            write_bronze(docs, f"{root}/bronze/{part}", "gzip")
            if part == "teams":
                cut_off(docs).write.mode("append").partitionBy("load_date").text(f"{root}/bronze/{part}")
            silver.run_silver(spark, f"{root}/bronze", f"{root}/silver", (part,), multiline=False, glob=None)
    _BUILT[key] = root
    return root


def pipeline_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = build(spark, sf_dir, "teams")
    return read_latest(spark, f"{root}/silver/team_matches").select(
        "team_name", "match_date", "opponent", "home_away", "result_status", "goals_scored", "goals_conceded", "xg_for",
        "xg_against", "load_date")


def pipeline_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = build(spark, sf_dir, "teams")
    return read_latest(spark, f"{root}/silver/team_statistics").select(
        "team_name", F.col("Situation").alias("situation"), F.col("Sh").alias("shots"), F.col("G").alias("goals"),
        F.col("extra")["Clearances"].alias("clearances"), F.size("extra").alias("n_extra"), "load_date")


def pipeline_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written trends mart over the written silver table."""
    root = build(spark, sf_dir, "teams")
    gold.run_gold(spark, f"{root}/silver", f"{root}/gold", marts=("team_match_trends",))
    return read_latest(spark, f"{root}/gold/team_match_trends").select(
        "team_name", "match_date", "opponent", "result_status", "goals_scored")


def pipeline_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = build(spark, sf_dir, "players")
    return read_latest(spark, f"{root}/silver/player_seasons").select(
        "player_name", "player_url", "season_year", "team_name", "appearances", "minutes_played", "goals", "xg", "load_date")


def pipeline_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings from documents over many lines, two loads, names conformed; one document is cut off."""
    root = build(spark, sf_dir, "league")
    return read_latest(spark, f"{root}/silver/league_standings").select(
        "team_name", "rank", "matches_played", "wins", "draws", "losses", "goals_for", "goals_against", "points", "xG_for", "xG_against",
        "load_date")


def pipeline_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that didn't parse, by part and load."""
    out = None
    for part in ("league", "teams"):
        root = build(spark, sf_dir, part)
        rows = read_latest(spark, f"{root}/silver/{silver.QUARANTINE}").groupBy("part", "load_date").agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(F.col("document").startswith("{")).alias("texts"))
        out = rows if out is None else out.union(rows)
    return out


def pipeline_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches after reruns of their load: rows whose date doesn't parse have no key, and are there once."""
    return read_latest(spark, f"{build(spark, sf_dir, 'reruns')}/silver/team_matches").select(*RERUN_COLUMNS)


def pipeline_load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each part's loads, with the number of teams in them."""
    root = build(spark, sf_dir, "reruns")
    docs = read_documents(spark, f"{root}/bronze/teams", schemas.TEAM_DOC, glob=None, multiline=False)
    teams = docs.groupBy(F.lit("teams").alias("part"), F.col("load_date").cast("string").alias("load_date")).agg(
        F.countDistinct("team_name").alias("teams"))
    return (ledger.states(spark, f"{root}/bronze", f"{root}/silver", silver.PARTS).join(teams, ["part", "load_date"], "left")
            .select("part", "load_date", "state", F.coalesce("teams", F.lit(0)).alias("teams")))


def summary_without_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written summary mart where no fixtures table was ever written: the upcoming list is skipped, next matches have the default."""
    root = shared_dir(spark, "no-fixtures")
    overwrite(spark, silver.league_standings(testbed.league_documents(spark, sf_dir)), f"{root}/silver/league_standings")
    overwrite(spark, silver.team_matches(testbed.result_documents(spark, sf_dir)), f"{root}/silver/team_matches")
    gold.run_gold(spark, f"{root}/silver", f"{root}/gold", marts=("team_summary", "league_upcoming_fixtures"))
    mart = register_view(read_latest(spark, f"{root}/gold/team_summary"), "written_summary")
    return mart.sparkSession.sql("SELECT rank, team_name, points, next_opponent, next_home_away FROM written_summary")


def enrich_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written summary mart with badges from a JSON array: the first badge in file order whose name contains the team's."""
    root = build(spark, sf_dir, "league")
    standings = read_latest(spark, f"{root}/silver/league_standings")
    badges = read_rows(spark, f"{root}/bronze/badges", schemas.BADGES, glob=None)
    return enrich.enrich_teams(standings.select("team_name", "points"), badges, cutoff=None).select(
        "team_name", "points", "team", "badge_url")


def enrich_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written season rows, summed per player, with profiles from several JSON arrays.

    Names are contained in one another (`player 1`, `player 12`), so the order of
    the files and of the rows in them decides; it isn't the order of the names.
    """
    root = build(spark, sf_dir, "players")
    profile = F.struct(F.concat(F.lit(" PLÁYER "), F.col("s_suppkey")).alias("name"), F.concat(F.lit("club "), F.col("s_suppkey")).alias("club"),
                       F.when(F.col("s_suppkey") % 2 == 0, "FW").alias("position"))
    lists = (read_table(spark, sf_dir, "supplier").filter("s_suppkey % 7 != 3")
             .groupBy(F.format_string("%02d", F.pmod("s_suppkey", F.lit(PROFILE_LISTS))).alias("list"))
             .agg(F.sort_array(F.collect_list(F.struct("s_suppkey", profile.alias("r"))), asc=False).alias("rows")))
    path = shared_dir(spark, "profiles")
    (lists.select("list", F.to_json(F.transform("rows", lambda x: x["r"])).alias("value"))
     .write.partitionBy("list").text(path))
    profiles = read_rows(spark, path, schemas.PROFILES, glob=None)
    players = read_latest(spark, f"{root}/silver/player_seasons").groupBy("player_name").agg(F.sum("appearances").alias("appearances"))
    return enrich.enrich_players(players, profiles, cutoff=None).select(
        "player_name", "appearances", F.col("name").alias("profile"), "club", "position", "nationality")


QUERIES = {f.__name__: f for f in (pipeline_matches, pipeline_statistics, pipeline_trends, pipeline_seasons, pipeline_standings,
                                   pipeline_quarantine, pipeline_rerun, pipeline_load_states, summary_without_fixtures,
                                   enrich_teams, enrich_players)}

# what the written path of each query exercises
COVERS = {
    "pipeline_matches": "SRC3 SRC4 SRC10 SNK2 SNK3 SNK4 SNK7 PRJ1 Q-MATCH",
    "pipeline_statistics": "SRC3 SRC4 SRC10 SNK3 PRJ5 Q-STATS",
    "pipeline_trends": "SRC6 SNK1 SNK3 PRJ12 Q-MATCH Q-TREND",
    "pipeline_standings": "SRC1 SRC2 SRC8 SNK2 SNK3 SNK4 PRJ1 PRJ4 PRJ6 PRJ7 Q-STAND (Q7: conformed names)",
    "pipeline_quarantine": "SRC1 SNK2",
    "pipeline_rerun": "SRC3 SRC4 SNK2 SNK3 SNK4 JN6 PRJ8 Q-MATCH",
    "pipeline_load_states": "SRC4 SRC5 SRC6",
    "summary_without_fixtures": "SRC7 SRC9 SNK1 Q-SUM",
    "enrich_teams": "SRC8 FZ1 FZ2 FZ4 FZ5 FZ6 JN3 JN5 SC5 PRJ14 PRJ15 Q-ENR",
    "enrich_players": "SRC8 FZ1 FZ2 FZ4 FZ5 FZ6 JN3 JN5 SC4 SC5 Q-ENR",
    "pipeline_seasons": "SRC4 SNK3 FLT1 PRJ6 PRJ7 Q-SEAS",
}

_LOADS_SQL = f"(VALUES (0, DATE '{LOADS[0][0]}'), (1, DATE '{LOADS[1][0]}')) AS l(ld, load_date)"
_TEAM_ROWS = f"""
  SELECT CAST(o_custkey AS VARCHAR) AS team_name, CAST(o_orderdate AS DATE) AS match_date, o_orderpriority AS opponent,
         CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'a' END AS home_away,
         CASE WHEN o_orderdate < TIMESTAMP '{AS_OF}' THEN lower(o_orderstatus) END AS result_status,
         CAST(floor(o_totalprice / 50000) + ld AS INTEGER) AS goals_scored, CAST(o_orderkey % 5 AS INTEGER) AS goals_conceded,
         CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 4.0 END AS xg_for, CAST(NULL AS DOUBLE) AS xg_against, load_date
  FROM orders, {_LOADS_SQL}
  WHERE ld = 0 OR o_custkey % 3 <> 0"""
_MATCHES = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY team_name, match_date, opponent ORDER BY load_date DESC, home_away DESC,
      result_status DESC NULLS LAST, goals_scored DESC, goals_conceded DESC, xg_for DESC NULLS LAST) AS rn
    FROM ({_TEAM_ROWS})) WHERE rn = 1"""
_UNDATED = _TEAM_ROWS.replace("ld = 0 OR o_custkey % 3 <> 0", "ld = 0").replace(
    "CAST(o_orderdate AS DATE) AS match_date", f"CASE WHEN o_orderkey % {UNDATED} <> 0 THEN CAST(o_orderdate AS DATE) END AS match_date")
# statistics keep one row per load (their key holds the time of the load)
_STATISTICS = f"""
  SELECT CAST(o_custkey AS VARCHAR) AS team_name, o_orderstatus AS situation, CAST(count(*) AS VARCHAR) AS shots,
         CAST(count(*) + any_value(ld) AS VARCHAR) AS goals, CAST(count(*) * 2 AS VARCHAR) AS clearances,
         CAST(1 AS INTEGER) AS n_extra, load_date
  FROM orders, {_LOADS_SQL}
  WHERE ld = 0 OR o_custkey % 3 <> 0
  GROUP BY o_custkey, o_orderstatus, ld, load_date"""
_SEASONS = f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT 'player ' || l_suppkey AS player_name, '/p/' || l_suppkey AS player_url,
           CAST(year(l_shipdate) AS VARCHAR) AS season_year, 'club ' || l_suppkey AS team_name,
           CAST(count(*) + ld AS INTEGER) AS appearances, CAST(sum(l_quantity) AS INTEGER) AS minutes_played,
           CAST(NULL AS INTEGER) AS goals, CAST(NULL AS DOUBLE) AS xg, load_date,
           row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY load_date DESC) AS rn
    FROM lineitem, {_LOADS_SQL}
    WHERE ld = 0 OR l_suppkey % 3 <> 0
    GROUP BY l_suppkey, year(l_shipdate), ld, load_date) WHERE rn = 1"""

_STANDINGS = f"""
  WITH o AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS w, count(*) FILTER (o_orderstatus = 'O') AS d
             FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
  SELECT (SELECT string_agg(upper(x[1]) || lower(x[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(n_name, ' ')) AS x,
            generate_subscripts(string_split(n_name, ' '), 1) AS i)) AS team_name,
         CAST(n_nationkey AS INTEGER) AS rank, CAST(n AS INTEGER) AS matches_played, CAST(w + 1 AS INTEGER) AS wins, CAST(d AS INTEGER) AS draws,
         CAST(n - w - d AS INTEGER) AS losses, CAST(2 * n AS INTEGER) AS goals_for, CAST(w AS INTEGER) AS goals_against,
         CAST(3 * w + d AS INTEGER) AS points, n_nationkey + 0.75 AS xG_for, CAST(NULL AS DOUBLE) AS xG_against,
         DATE '{LOADS[1][0]}' AS load_date
  FROM nation JOIN o ON k = n_nationkey JOIN region ON r_regionkey = n_regionkey"""
ORACLE_SQL = {
    "pipeline_standings": f"SELECT * REPLACE (CAST(xG_for AS DOUBLE) AS xG_for) FROM ({_STANDINGS})",
    "pipeline_quarantine": f"""
  SELECT 'league' AS part, DATE '{LOADS[1][0]}' AS load_date, CAST(1 AS BIGINT) AS documents, CAST(1 AS BIGINT) AS texts
  UNION ALL SELECT 'teams', load_date, count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders, {_LOADS_SQL}
  WHERE (ld = 0 OR o_custkey % 3 <> 0) AND o_custkey % {BROKEN} = 0 GROUP BY load_date""",
    "pipeline_rerun": f"""
  SELECT {", ".join(RERUN_COLUMNS)} FROM ({_UNDATED}) WHERE match_date IS NULL
  UNION ALL SELECT {", ".join(RERUN_COLUMNS)} FROM ({_MATCHES.replace(_TEAM_ROWS, _UNDATED)}) WHERE match_date IS NOT NULL""",
    "pipeline_load_states": f"""
  SELECT 'teams' AS part, '{LOADS[0][0]}' AS load_date, '{ledger.MERGED}' AS state, count(DISTINCT o_custkey) AS teams FROM orders
  UNION ALL SELECT 'teams', '{LOADS[1][0]}', '{ledger.NEW}', count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 3 <> 0
  UNION ALL SELECT x, NULL, '{ledger.NO_LOAD}', 0 FROM (VALUES ('league'), ('players')) AS v(x)""",
    "summary_without_fixtures": f"""
  SELECT rank, team_name, points, '{gold.NO_FIXTURE_OPPONENT}' AS next_opponent, '{gold.NO_FIXTURE_SIDE}' AS next_home_away
  FROM ({testbed.ORACLE_SQL["gold_team_summary"]})""",
    "enrich_players": f"""
  SELECT player_name, appearances, ' PLÁYER ' || s_suppkey AS profile, 'club ' || s_suppkey AS club,
         CASE WHEN s_suppkey % 2 = 0 THEN 'FW' END AS position, CAST(NULL AS VARCHAR) AS nationality
  FROM (SELECT player_name, CAST(sum(appearances) AS BIGINT) AS appearances,
               (SELECT arg_min(s_suppkey, (s_suppkey % {PROFILE_LISTS}) * 1000000000 - s_suppkey) FROM supplier
                WHERE s_suppkey % 7 <> 3 AND (contains('player ' || s_suppkey, player_name) OR contains(player_name, 'player ' || s_suppkey))) AS k
        FROM ({_SEASONS}) GROUP BY player_name) LEFT JOIN supplier ON s_suppkey = k""",
    # the first nation by key, of those with a badge, whose badge text holds the name
    "enrich_teams": f"""
  SELECT team_name, points, 'The ' || b.n_name || ' FC' AS team, 'b/' || b.n_nationkey || '.png' AS badge_url
  FROM ({_STANDINGS}) t LEFT JOIN nation b ON b.n_nationkey = (
    SELECT min(n_nationkey) FROM nation n WHERE n_nationkey % 5 <> 4 AND contains('the ' || lower(n.n_name) || ' fc', lower(t.team_name)))""",
    "pipeline_matches": _MATCHES,
    "pipeline_statistics": _STATISTICS,
    "pipeline_trends": f"""SELECT team_name, match_date, opponent, result_status, goals_scored FROM ({_MATCHES})""",
    "pipeline_seasons": _SEASONS,
}
