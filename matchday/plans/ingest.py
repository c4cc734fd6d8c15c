"""Documents, bucketed merges and lookup marts on the driver's tables, with DuckDB oracles.

A *team* is a customer; its results are orders before `AS_OF`, its fixtures later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import to_double
from ..functions.text import drop_newlines, name_lookup_key, strip_suffix
from ..operators import nested, reshape
from ..operators.buckets import merge_buckets, read_buckets
from ..operators.export import stamp
from ..operators.upsert import write_lookup
from ..session import shared_dir
from ..sources.tables import read_table
from . import gold, serve

AS_OF = "1999-01-01"
FIRST_MATCHES = 5
SEASON = "1994-08-01"
SLUGS = ("customer-000000007", "CUSTOMER-000000042", "customer-nobody", "")


def packaged(spark: SparkSession, sf_dir: str, salt: int = 1) -> DataFrame:
    """Documents of four parts from two scans and one shuffle."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    key, played = F.col("o_orderkey"), F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    # a blank date for every eleventh match, as the pages' summary rows have
    result = F.struct(key.alias("id"), F.when(key % 11 == 0, "").otherwise(date).alias("Date"), F.col("o_orderstatus").alias("result"))
    fixture = F.struct(key.alias("id"), date.alias("Date"), F.col("o_orderpriority").alias("opponent"))
    cells = F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit("/t/"), "c_custkey"), "c_mktsegment")
    player = F.struct(F.concat(F.lit("player of "), "c_name").alias("Player"),
                      F.when(F.col("c_nationkey") != 3, F.concat(F.lit("/p/"), "c_custkey")).alias("Player_URL"))
    rows = [reshape.part_rows(o, "o_custkey", results=F.when(played, result), fixtures=F.when(~played | played.isNull(), fixture)),
            reshape.part_rows(c, "c_custkey", statistics=reshape.row_record(cells), roster=player)]
    return reshape.package_parts(rows, {"results": ["Date", "id"], "fixtures": ["Date", "id"], "statistics": ["Team"],
                                        "roster": ["Player"]}, salt)


def package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents hold, part by part; the first matches are those of the pages, without summary rows."""
    docs = packaged(spark, sf_dir)
    ids = lambda a: F.array_join(F.transform(a, lambda r: r["id"].cast("string")), ",")
    roster = reshape.flatten_roster(docs, "key", "roster").select(F.col("team_name").alias("key"), "player_name", "player_url")
    return (docs.join(roster, "key", "left")
            .select(F.col("key").alias("team"), F.size("results").alias("n_results"),
                    ids(reshape.first_k(reshape.drop_blank_rows("results", "Date"), FIRST_MATCHES)).alias("first_results"),
                    ids("fixtures").alias("fixtures"), F.get("statistics", 0)["URL"].alias("url"),
                    F.size(F.get("statistics", 0)["Data"]).alias("n_cells"), "player_name", "player_url"))


def merge_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then a load that changes those of a few customers and adds new ones."""
    path = shared_dir(spark, "buckets")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(0).alias("load"))
    merge_buckets(spark, path, o, ["o_orderkey"], "load")
    few = o.filter(F.col("o_custkey") % 50 == 7)
    changed = few.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("load", F.lit(1))
    new = few.withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("load", F.lit(1))
    merge_buckets(spark, path, changed.union(changed).union(new), ["o_orderkey"], "load")
    return read_buckets(spark, path)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    totals = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("matches"), F.max(price).alias("best"), F.min(price).alias("worst"),
                                        F.max(F.when(F.col("o_orderstatus") == "P", price)).alias("best_drawn"))
    return c.join(totals, c.c_custkey == totals.o_custkey, "left").select(
        F.col("c_name").alias("player_name"), "c_custkey", "matches", "best", "worst", "best_drawn")


def leaders_all_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.leaders_of_all(_totals(spark, sf_dir), ["matches", "best", "worst", "best_drawn"])


def api_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by slug from a written lookup mart; a slug that names nobody gives nulls here, an empty result there."""
    root = shared_dir(spark, "gold")
    write_lookup(spark, _totals(spark, sf_dir), f"{root}/{gold.PLAYERS_BY_NAME}", name_lookup_key("player_name"))
    out = None
    for slug in SLUGS:
        hit = serve.profile(spark, root, slug)
        row = spark.range(1).select(F.lit(slug).alias("slug")).join(
            hit.select(F.lit(slug).alias("slug"), "player_name", "matches", "best"), "slug", "left")
        out = row if out is None else out.union(row)
    return out


def _player_rows(spark: SparkSession, sf_dir: str, load: int) -> DataFrame:
    """Orders as a player's matches, typed; the second load has some customers' again, with a goal more and fewer minutes."""
    o = read_table(spark, sf_dir, "orders")
    minutes = F.when(F.col("o_custkey") % 50 == 7, F.lit(90 if load == 0 else 0)).otherwise(90)
    return o.filter(F.lit(True) if load == 0 else F.col("o_custkey") % 25 == 7).groupBy(
        F.concat(F.lit("player "), F.col("o_custkey")).alias("player_name"), F.to_date("o_orderdate").alias("match_date"), "o_custkey").agg(
        F.max(F.col("o_orderkey") % 4 + load).cast("int").alias("goals"), F.max("o_orderkey").alias("k")).select(
        "player_name", F.lit("/p").alias("player_url"), "match_date", minutes.alias("minutes_played"), "goals",
        (F.col("k") % 3).cast("int").alias("assists"), (F.col("k") % 8 / 4).alias("xg"), F.lit(0.25).alias("xa"),
        F.lit(f"2024-05-0{load + 1}").cast("date").alias("load_date"), F.lit(f"2024-05-0{load + 1} 09:00:00").cast("timestamp").alias("updated_at"))


def refresh_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring mart after a second load, of which only the changed players are added up again."""
    root = shared_dir(spark, "refresh")
    for load in (0, 1):
        gold.refresh_player_scoring(spark, f"{root}/player_matches", f"{root}/player_scoring_stats", _player_rows(spark, sf_dir, load),
                                    season_start=SEASON)
    return read_buckets(spark, f"{root}/player_scoring_stats")


def scraped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a page has them, one per order: a superscript glued to the value, line breaks inside names, helper columns of a join.

    A third of the orders have a superscript, which every fifth value lacks; of those
    without one every fourth value ends like it, and stays as it is.
    """
    key, glued = F.col("o_orderkey"), "+0.12"
    sup = F.when(key % 3 == 0, glued).when(key % 3 == 1, "")
    ends = F.when(((key % 3 == 0) & (key % 5 != 0)) | ((key % 3 == 1) & (key % 4 == 0)), glued).otherwise("")
    name = F.concat(F.substring("o_orderpriority", 1, 2), F.lit("\r\n"), F.substring("o_orderpriority", 3, 20), F.lit("\n"))
    page = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.concat(F.lit(" "), key, F.lit(".25"), ends).alias("Value"), sup.alias("Sup"), name.alias("Name")).alias("cell"),
        F.lit("x").alias("join_name"), F.lit("y").alias("left_join_name"))
    rows = stamp(nested.drop_matching(page, "join_name"), "2024-05-01 09:00:00", "2024-05-01", "tables")
    text = strip_suffix("cell.value", "cell.SUP")
    return rows.select("o_orderkey", text.alias("value_text"), to_double(text).alias("value"), drop_newlines("cell.name").alias("name"),
                       F.col("_metadata.load_date").alias("load_date"))


QUERIES = {f.__name__: f for f in (scraped_cells, package_documents, merge_in_buckets, leaders_all_measures, api_profile, refresh_scoring)}

COVERS = {
    "scraped_cells": "SC6 SC7 SC21 PRJ3 PRJ7 PRJ13 SNK7",
    "package_documents": "ING2 ING4 ING5 ING6 ING7 ORD7 PRJ1",
    "merge_in_buckets": "SNK2 SNK3 SNK4 JN6 JN7 SET3",
    "leaders_all_measures": "Q-API4 ORD4 WIN3 FLT9",
    "refresh_scoring": "SNK2 SNK3 Q-PLAY AGG1 AGG2 AGG3 AGG4 AGG5 FLT3 FLT5",
    "api_profile": "Q-API3 FLT8 FLT11 SRC6 SNK1",
}

_TOTALS = """SELECT c_name AS player_name, matches, best, worst, best_drawn FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS matches, max(o_totalprice) AS best, min(o_totalprice) AS worst,
           max(o_totalprice) FILTER (o_orderstatus = 'P') AS best_drawn FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""

ORACLE_SQL = {
    "scraped_cells": """
  SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN '.25+0.12' ELSE '.25' END AS value_text,
         CASE WHEN o_orderkey % 3 <> 1 OR o_orderkey % 4 <> 0 THEN o_orderkey + CAST(0.25 AS DOUBLE) END AS value, o_orderpriority AS name,
         '2024-05-01' AS load_date FROM orders""",
    "package_documents": f"""
  WITH o AS (SELECT *, o_orderdate < TIMESTAMP '{AS_OF}' AS played, strftime(o_orderdate, '%Y-%m-%d') AS d,
                    row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '{AS_OF}', o_orderkey % 11 = 0
                                       ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS i FROM orders),
  p AS (SELECT o_custkey, CAST(count(*) FILTER (played) AS INTEGER) AS n_results,
               coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY d, o_orderkey) FILTER (played AND o_orderkey % 11 <> 0 AND i <= {FIRST_MATCHES}), '') AS first_results,
               coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY d, o_orderkey) FILTER (NOT played), '') AS fixtures
        FROM o GROUP BY o_custkey)
  SELECT coalesce(c_custkey, o_custkey) AS team, coalesce(n_results, 0) AS n_results, coalesce(first_results, '') AS first_results,
         coalesce(fixtures, '') AS fixtures, '/t/' || c_custkey AS url, CAST(4 AS INTEGER) AS n_cells,
         CASE WHEN c_nationkey <> 3 THEN 'player of ' || c_name END AS player_name, CASE WHEN c_nationkey <> 3 THEN '/p/' || c_custkey END AS player_url
  FROM customer FULL JOIN p ON o_custkey = c_custkey""",
    "merge_in_buckets": """
  SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         CAST(CASE WHEN o_custkey % 50 = 7 THEN 1 ELSE 0 END AS INTEGER) AS load FROM orders
  UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, CAST(1 AS INTEGER) FROM orders WHERE o_custkey % 50 = 7""",
    "leaders_all_measures": f"""
  SELECT measure, CAST(position AS INTEGER) AS position, name, value FROM (
    SELECT measure, name, value, row_number() OVER (PARTITION BY measure ORDER BY value DESC, name) AS position FROM (
      SELECT 'matches' AS measure, player_name AS name, CAST(matches AS DOUBLE) AS value FROM ({_TOTALS})
      UNION ALL SELECT 'best', player_name, best FROM ({_TOTALS}) UNION ALL SELECT 'worst', player_name, worst FROM ({_TOTALS})
      UNION ALL SELECT 'best_drawn', player_name, best_drawn FROM ({_TOTALS})) WHERE value IS NOT NULL) WHERE position <= {serve.LEADERS_LIMIT}""",
    "refresh_scoring": f"""
  WITH m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey % 4) AS g, max(o_orderkey) AS k FROM orders GROUP BY ALL),
  s AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_custkey % 50 = 7 THEN 0 ELSE 90 END) AS minutes,
               sum(CASE WHEN o_custkey % 25 = 7 THEN g + 1 ELSE g END) AS goals, sum(k % 3) AS assists, sum(k % 8) / 4 AS xg
        FROM m WHERE d >= DATE '{SEASON}' GROUP BY o_custkey)
  SELECT 'player ' || o_custkey AS player_name, CAST(n AS BIGINT) AS matches_played, CAST(minutes AS BIGINT) AS total_minutes,
         CAST(goals AS BIGINT) AS total_goals, CAST(assists AS BIGINT) AS total_assists, CAST(xg AS DOUBLE) AS total_xg,
         CAST(n / 4 AS DOUBLE) AS total_xa, CAST(goals - xg AS DOUBLE) AS xg_performance
  FROM s WHERE minutes > 0""",
    "api_profile": f"""
  SELECT slug, player_name, matches, best FROM (VALUES {', '.join(f"('{x}')" for x in SLUGS)}) AS s(slug)
  LEFT JOIN ({_TOTALS}) ON lower(replace(player_name, '#', ' ')) = lower(replace(slug, '-', ' '))""",
}
