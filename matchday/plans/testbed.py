"""The library's operators run on the driver's test tables.

The football data model is mapped onto the TPC-H-style tables:

* a *team* is a customer; a *team match* is an order (`team_matches`): the
  date is `o_orderdate`, the opponent label is `o_orderpriority`, the side is
  home for the three highest priorities, the result comes from `o_orderstatus`
  (F win, O draw, P loss, anything else unknown), goals scored are the
  priority digit and goals conceded follow from the result;
* a *player* is a supplier; a *player match* is a line item
  (`player_matches`): minutes = quantity, goals / assists = tax / discount
  in hundredths, xG = quantity / 10 (null for return flag N, Q9),
  xA = discount * 10;
* matches before `AS_OF` are results, those on or after it are fixtures.

Each query takes `(spark, sf_dir)` and returns a DataFrame over the whole
tables; `ORACLE_SQL` holds the same query in DuckDB SQL. Oracle SQL follows
Spark's semantics where engines differ: rounding is half-up on the double's
shortest decimal text (`_r`), `try_cast` of text to int accepts integers only
(`_int_text`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, metrics, text
from ..functions.names import clean_names
from ..operators import aggregates, joins, nested, ranking, reshape, resolve, upsert
from ..operators.export import export_json, read_export
from ..session import shared_dir
from ..sources.tables import read_table

# Fixed run parameters of the registered queries.
AS_OF = "2000-01-01"          # matches on/after this date are fixtures
SEASON_START = "1999-01-01"   # season filter of the scoring mart
UPSERT_SPLIT = "2024-01-16"   # events before: target table; from: new load
SELECTED_TEAM = "CUSTOMER#000000007"
SELECTED_SLUG = "CUSTOMER-000000042"
SELECTED_NATION = "nation_7"
SELECTED_PART = 42
HOME_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")  # these orders are "home" matches
FORM_LENGTH = 5
RECENT_LIMIT = 20
LEADERS_LIMIT = 10
SQUAD_LIMIT = 6
SIMILAR_LIMIT = 8
LAST_K = 3

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------------------------------------
# derived relations
# ---------------------------------------------------------------------------------------------

def team_matches(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    status = F.col("o_orderstatus")
    result = (F.when(status == "F", "w").when(status == "O", "d").when(status == "P", "l"))
    scored = casts.to_int(F.substring("o_orderpriority", 1, 1))
    return (o.select(
        F.col("o_custkey").alias("team_key"),
        F.col("o_orderkey").alias("match_key"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.date_format("o_orderdate", "HH:mm").alias("kickoff"),
        F.col("o_orderpriority").alias("opponent"),
        F.when(F.col("o_orderpriority").isin(*HOME_PRIORITIES), "h").otherwise("a").alias("home_away"),
        result.alias("result_status"),
        scored.alias("goals_scored"),
        (F.col("o_totalprice") / 100000).alias("xg_for"),
        (F.col("o_totalprice") / 200000).alias("xg_against"))
        .withColumn("goals_conceded",
                    F.when(F.col("result_status") == "l", F.col("goals_scored") + 1)
                    .when(F.col("result_status") == "d", F.col("goals_scored"))
                    .when(F.col("result_status") == "w", F.col("goals_scored") - 1)))


def results(spark: SparkSession, d: str) -> DataFrame:
    return team_matches(spark, d).filter(F.col("match_date") < F.lit(AS_OF).cast("date"))


def fixtures(spark: SparkSession, d: str) -> DataFrame:
    return team_matches(spark, d).filter(F.col("match_date") >= F.lit(AS_OF).cast("date"))


def player_matches(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(
        F.col("l_suppkey").alias("player_key"),
        F.col("o_custkey").alias("team_key"),
        F.col("l_orderkey").alias("match_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.col("l_quantity").cast("int").alias("minutes"),
        F.round(F.col("l_tax") * 100).cast("int").alias("goals"),
        F.round(F.col("l_discount") * 100).cast("int").alias("assists"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity") / 10).alias("xg"),
        (F.col("l_discount") * 10).alias("xa"),
        F.col("l_returnflag").alias("position"))


# ---------------------------------------------------------------------------------------------
# marts
# ---------------------------------------------------------------------------------------------

def q_player_scoring_stats(spark, d):
    pm = player_matches(spark, d).filter(
        (F.col("match_date") >= F.lit(SEASON_START).cast("date")) & (F.col("match_date") < F.lit(AS_OF).cast("date")))
    return aggregates.scoring_totals(pm, "player_key", "match_date", "minutes", "goals", "assists", "xg", "xa")


def q_team_form_last5(spark, d):
    r = results(spark, d).filter(F.col("result_status").isNotNull())
    form = ranking.ordered_array(r, "team_key", [F.col("match_date").desc(), F.col("match_key").desc()],
                                 F.upper("result_status"), FORM_LENGTH, "form_array")
    return form.select("team_key", F.array_join("form_array", "").alias("form"))


def q_next_fixture(spark, d):
    fx = fixtures(spark, d)
    nxt = ranking.first_per_key(fx, "team_key", [F.col("match_date").asc(), F.col("match_key").asc()])
    return nxt.select("team_key", F.col("match_date").alias("next_date"),
                      F.col("opponent").alias("next_opponent"), F.col("home_away").alias("next_home_away"))


def standings(spark, d) -> DataFrame:
    r = results(spark, d)
    st = (r.groupBy("team_key").agg(
        F.count(F.lit(1)).cast("int").alias("matches_played"),
        F.count_if(F.col("result_status") == "w").cast("int").alias("wins"),
        F.count_if(F.col("result_status") == "d").cast("int").alias("draws"),
        F.count_if(F.col("result_status") == "l").cast("int").alias("losses"),
        F.sum("goals_scored").cast("int").alias("goals_for"),
        F.sum("goals_conceded").cast("int").alias("goals_against")))
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("team_key"),
                                                   F.col("c_name").alias("team_name"))
    zero = ["matches_played", "wins", "draws", "losses", "goals_for", "goals_against"]
    base = cust.join(st, "team_key", "left").select(
        "team_key", "team_name", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero])
    return base.withColumns({
        "points": (F.col("wins") * 3 + F.col("draws")).cast("int"),
        "goal_difference": metrics.difference("goals_for", "goals_against", None)})


def q_team_summary(spark, d):
    st = standings(spark, d)
    form = q_team_form_last5(spark, d)
    nxt = q_next_fixture(spark, d).drop("next_date")
    joined = joins.left_enrich(joins.left_enrich(st, form, ["team_key"]), nxt, ["team_key"])
    ranked = ranking.global_row_number(
        joined, [F.col("points").desc(), F.col("goal_difference").desc(), F.col("goals_for").desc(),
                 F.col("team_key").asc()], "rank")
    return ranked.select("rank", "team_key", "team_name", "matches_played", "wins", "draws", "losses",
                         "points", "goals_for", "goals_against", "goal_difference", "form",
                         "next_opponent", "next_home_away")


def q_match_trends(spark, d):
    tm = team_matches(spark, d)
    return (tm.select("team_key", "match_key", "match_date", "opponent", "home_away", "result_status",
                      "goals_scored", "goals_conceded", "xg_for", "xg_against")
            .orderBy(F.col("team_key").asc(), F.col("match_date").desc(), F.col("match_key").desc()))


def q_tactics(spark, d):
    li = read_table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    rows = li.select(
        F.col("l_suppkey").alias("team_key"),
        F.when(flag == "A", "Open Play").when(flag == "N", "Set Piece").when(flag == "R", "Corner")
        .alias("play_type"),
        F.round(F.col("l_tax") * 100).cast("int").alias("goals"),
        (F.col("l_quantity") / 10).alias("xg"))
    agg = (rows.filter(F.col("play_type").isNotNull())
           .groupBy("team_key", "play_type").agg(
               F.sum("goals").cast("int").alias("goals_scored"),
               F.round(F.sum("xg"), 2).alias("expected_goals"),
               F.count(F.lit(1)).cast("int").alias("total_shots")))
    return (agg.withColumn("xg_per_shot", F.round(F.col("expected_goals") / F.col("total_shots"), 3))
            .withColumn("performance", metrics.difference("goals_scored", "expected_goals", 2))
            .withColumn("flag", metrics.sign_flag("performance")))


def q_recent_top20(spark, d):
    r = results(spark, d).filter(F.col("home_away") == "h")
    out = r.select("match_date", F.col("team_key").alias("home_team"), F.col("goals_scored").alias("home_goals"),
                   F.col("goals_conceded").alias("away_goals"), F.col("opponent").alias("away_team"), "match_key")
    return ranking.top_k(out, [F.col("match_date").desc(), F.col("match_key").desc()], RECENT_LIMIT)


def q_upcoming_top20(spark, d):
    fx = fixtures(spark, d).filter(F.col("home_away") == "h")
    out = fx.select(F.col("match_date").alias("fixture_date"), F.col("kickoff").alias("fixture_time"),
                    F.col("team_key").alias("home_team"), F.col("opponent").alias("away_team"), "match_key")
    return ranking.top_k(out, [F.col("fixture_date").asc(), F.col("match_key").asc()], RECENT_LIMIT)


def _leaders(measure):
    def q(spark, d):
        return ranking.leaders(q_player_scoring_stats(spark, d), measure, "player_key", LEADERS_LIMIT)
    return q


def q_squad_sorted(spark, d):
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    # nation has 25 rows by definition of the schema: a fixed, proven bound
    nat = F.broadcast(n.filter(F.lower("n_name") == SELECTED_NATION.lower())
                      .select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    squad = s.join(nat, "s_nationkey").select("s_suppkey", "s_name", "s_acctbal", "n_name")
    return ranking.sort_by_choice(squad, "s_acctbal", "desc", "s_suppkey", SQUAD_LIMIT)


def q_profile_lookup(spark, d):
    c = read_table(spark, d, "customer")
    hit = c.filter(text.name_lookup_key("c_name") == text.slug_to_name(SELECTED_SLUG))
    return ranking.top_k(hit.select("c_custkey", "c_name", "c_acctbal"), [F.col("c_custkey").asc()], 1)


def q_per90_metrics(spark, d):
    st = q_player_scoring_stats(spark, d)
    return st.select(
        "player_key", "total_minutes",
        metrics.per90("total_goals", "total_minutes").alias("goals_per90"),
        metrics.per90("total_assists", "total_minutes").alias("assists_per90"),
        metrics.capped_percent("total_goals").alias("goals_pct"),
        metrics.capped_percent("total_xg").alias("xg_pct"))


def q_zones(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    ranked = ranking.global_row_number(s, [F.col("s_acctbal").desc(), F.col("s_suppkey").asc()], "rank",
                                       total_alias="n_teams")
    return ranked.select("s_suppkey", "s_name", "rank", metrics.zone("rank", "n_teams").alias("zone"))


def q_outcome_labels(spark, d):
    tm = team_matches(spark, d)
    return tm.select(
        "team_key", "match_key",
        metrics.outcome("goals_scored", "goals_conceded").alias("outcome"),
        metrics.side_label("home_away").alias("side"),
        text.code3(F.substr("opponent", F.lit(3))).alias("code"),
        text.first_part(casts.format_match_date("match_date")).alias("date_label"))


def q_similar_items(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    sel = p.filter(F.col("p_partkey") == SELECTED_PART).select("p_type").first()
    group_value = sel["p_type"] if sel else None
    return ranking.same_group_first(p, "p_type", group_value, "p_partkey", SELECTED_PART,
                                    "p_partkey", "p_name", SIMILAR_LIMIT, "slot")


def q_last3_chronological(spark, d):
    r = results(spark, d).select("team_key", "match_key", "match_date", "result_status")
    return ranking.last_k_oldest_first(r, "team_key", "match_date", "match_key", LAST_K, "pos")


def q_opponent_lookup(spark, d):
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    cust = joins.lookup(read_table(spark, d, "customer"), nation, "c_nationkey", "n_nationkey", "badge_",
                        ["n_name"]).select("c_custkey", "badge_n_name")
    supp = joins.lookup(read_table(spark, d, "supplier"), nation, "s_nationkey", "n_nationkey", "badge_",
                        ["n_name"]).select("s_suppkey", "badge_n_name")
    # The team badge is attached on the orders side (a quarter of the line items),
    # so the line items are shuffled twice (order key, supplier key), not three times.
    orders = joins.lookup(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), cust,
                          "o_custkey", "c_custkey", "team_", ["badge_n_name"])
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    pm = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    out = joins.lookup(pm, supp, "l_suppkey", "s_suppkey", "opponent_", ["badge_n_name"])
    return out.select(F.col("l_orderkey").alias("match_key"), F.col("l_linenumber").alias("line_no"),
                      F.col("o_custkey").alias("team_key"), F.col("l_suppkey").alias("player_key"),
                      F.col("team_badge_n_name").alias("team_badge"),
                      F.col("opponent_badge_n_name").alias("opponent_badge"))


def q_json_flatten(spark, d):
    e = read_table(spark, d, "events")
    parsed = e.withColumn("p", nested.parse_json_text("props", "k INT"))
    return parsed.select("event_id", "event_type", F.col("p.k").alias("k"),
                         nested.to_json_text(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type")))
                         .alias("props_norm"))


def q_explode_tokens(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("arr"))
    return nested.explode_positions(
        p, "arr", keep=["p_partkey", nested.cell("arr", 0).alias("first_token"),
                        nested.cell("arr", 2).alias("third_token")], pos="pos", value="token")


def q_safe_casts(spark, d):
    e = read_table(spark, d, "events")
    vtext = F.col("value").cast("string")
    ts_text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select(
        "event_id",
        casts.to_int(F.regexp_extract("props", r":\s*(\d+)", 1)).alias("k_int"),
        casts.to_int("event_type").alias("type_as_int"),
        casts.to_int(vtext).alias("value_as_int"),
        casts.to_int_truncated(vtext).alias("value_trunc"),
        casts.to_double(vtext).alias("value_back"),
        # parse, then back to wall-clock time: independent of the session time zone
        casts.parse_timestamp(ts_text).cast("timestamp_ntz").alias("ts_parsed"),
        casts.parse_match_date(casts.format_match_date(F.col("ts").cast("date"))).alias("date_roundtrip"),
        casts.parse_match_date(F.date_format("ts", "yyyy-MM-dd")).alias("iso_roundtrip"),
        casts.parse_match_date("event_type").alias("bad_date"))


_EVENT_KEYS = ["user_id", "event_type"]


def q_upsert_latest(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    split = F.lit(UPSERT_SPLIT).cast("timestamp_ntz")
    target = upsert.dedupe_latest(e.filter(F.col("ts") < split), _EVENT_KEYS, "ts", ["event_id"])
    source = e.filter(F.col("ts") >= split)
    return upsert.upsert(target, source, _EVENT_KEYS, "ts", ["event_id"])


def q_dedupe_latest(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return upsert.dedupe_latest(e, _EVENT_KEYS, "ts", ["event_id"])


def q_optional_source_default(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    nxt = q_next_fixture(spark, d).select(F.col("team_key").alias("c_custkey"), "next_opponent", "next_home_away")
    j = joins.left_enrich(c, nxt, ["c_custkey"])
    return j.select("c_custkey",
                    F.coalesce("next_opponent", F.lit("TBD")).alias("next_opponent"),
                    F.coalesce("next_home_away", F.lit("h")).alias("next_home_away"),
                    metrics.first_present("c_mktsegment", default="Unknown Club").alias("club"))


def q_in_team(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    wins = (results(spark, d).filter((F.col("result_status") == "w")
                                     & (F.col("match_date") >= F.lit(SEASON_START).cast("date")))
            .select(F.col("team_key").alias("c_custkey")))
    return joins.members(c, wins, ["c_custkey"])


def q_orient_sides(spark, d):
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus",
        F.col("l_suppkey").alias("home"), F.col("l_partkey").alias("away"),
        F.round(F.col("l_tax") * 100).cast("int").alias("home_goals"),
        F.round(F.col("l_discount") * 100).cast("int").alias("away_goals"),
        F.when(F.col("l_linestatus") == "F", F.lit("final")).alias("result"))
    played, upcoming = reshape.split_played(li, "result")
    keep = ["l_orderkey", "l_linenumber"]
    a = reshape.orient_sides(played, "home", "away", "home_goals", "away_goals", keep).withColumn("status", F.lit("played"))
    b = (reshape.orient_sides(upcoming, "home", "away", "home_goals", "away_goals", keep)
         .withColumn("goals_for", F.lit(None).cast("int")).withColumn("goals_against", F.lit(None).cast("int"))
         .withColumn("status", F.lit("upcoming")))
    return a.unionByName(b)


def q_header_zip(spark, d):
    p = read_table(spark, d, "part")
    headers = F.array(F.lit("Brand"), F.lit("Type"), F.lit("Size"))
    cells = F.array("p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    m = p.select("p_partkey", reshape.zip_headers(headers, cells).alias("m"))
    return m.select("p_partkey", F.col("m")["Brand"].alias("brand"), F.col("m")["Type"].alias("type"),
                    casts.to_int(F.col("m")["Size"]).alias("size"),
                    casts.to_double(F.col("m")["Column_3"]).alias("price"))


def q_package_nested(spark, d):
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # one order has a handful of lines (bounded by the order, not by the data size)
    nested_lines = reshape.nest_by(li, "l_orderkey", "lines", ["l_linenumber", "l_quantity"], ["l_linenumber"])
    doc = o.join(nested_lines, o["o_orderkey"] == nested_lines["l_orderkey"]).drop("l_orderkey")
    return doc.select("o_orderkey", "o_custkey", F.size("lines").alias("n_lines"),
                      F.explode("lines").alias("line")).select(
        "o_orderkey", "o_custkey", "n_lines", F.col("line.l_linenumber").alias("line_no"),
        F.col("line.l_quantity").alias("quantity"))


def _resolution_inputs(spark, d):
    p = read_table(spark, d, "part")
    names = (p.select(F.get(F.split("p_name", " "), 1).alias("n"))
             .unionByName(p.select(F.col("p_type").alias("n"))))
    choices = p.groupBy("p_name").agg(F.min("p_partkey").alias("position"))
    return names, choices


def q_name_resolution_contains(spark, d):
    names, choices = _resolution_inputs(spark, d)
    keys = resolve.resolve_keys(clean_names(names.distinct(), "n", "name").select("name"),
                                clean_names(choices, "p_name", "choice").select("choice", "position"),
                                cutoff=None)
    return keys.select("name", "resolved", "rule")


def q_name_resolution_ratio(spark, d):
    p = read_table(spark, d, "part")
    # names = product names with their second letter dropped
    names = p.select(F.concat(F.substring("p_name", 1, 1), F.substr("p_name", F.lit(3))).alias("n")).distinct()
    choices = p.groupBy("p_name").agg(F.min("p_partkey").alias("position"))
    keys = resolve.resolve_keys(clean_names(names, "n", "name").select("name"),
                                clean_names(choices, "p_name", "choice").select("choice", "position"))
    return keys.select("name", "resolved", "rule", "score")


def q_export_roundtrip(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = shared_dir(spark, "export-customer")
    export_json(c, path)
    return read_export(spark, path, c.schema)


def q_summary_for_team(spark, d):
    s = q_team_summary(spark, d)
    return s.filter(F.lower("team_name") == SELECTED_TEAM.lower())


def q_silver_team_matches(spark, d):
    """The silver builder for team results, run on bronze-style documents made from
    the orders: one document per order, every leaf text in the page's format
    (`Sep 29, 2025` dates, numbers as text, `""` for a missing value)."""
    from .. import schemas
    from . import silver
    tm = team_matches(spark, d)
    as_text = {
        "date": casts.format_match_date("match_date"),
        "opponent": F.col("match_key").cast("string"),
        "side": F.col("home_away"),
        "result": F.col("result_status"),
        "team_score": F.col("goals_scored").cast("string"),
        "opponent_score": F.col("goals_conceded").cast("string"),
        "team_xg": F.col("xg_for").cast("string"),
        "opponent_xg": F.lit(""),
        "match_link": F.lit(""),
    }
    docs = tm.select(
        F.col("team_key").cast("string").alias("team_name"),
        F.array(F.struct(*[as_text[f].alias(f) for f in schemas.RESULT_FIELDS])).alias("results"),
        F.struct(F.date_format("match_date", "yyyy-MM-dd 00:00:00").alias("extraction_timestamp"),
                 F.date_format("match_date", "yyyy-MM-dd").alias("load_date"),
                 F.lit("orders").alias("source")).alias("meta"),
        F.col("match_date").alias("load_date"))
    out = silver.team_matches(docs)
    return out.select("team_name", "match_date", "opponent", "home_away", "result_status", "goals_scored",
                      "goals_conceded", "xg_for", "xg_against", "load_date")


def as_text(c: str):
    return F.col(c).cast("string")


def _stamped(source: str):
    return (F.struct(F.lit(f"{AS_OF} 00:00:00").alias("extraction_timestamp"), F.lit(AS_OF).alias("load_date"),
                     F.lit(source).alias("source")).alias("meta"), F.lit(AS_OF).cast("date").alias("load_date"))


def _match_documents(tm: DataFrame, part: str, fields: dict, name=as_text) -> DataFrame:
    """One bronze-style team document per match: `{team_name, <part>: [one struct], meta, load_date}`."""
    from .. import schemas
    names = schemas.RESULT_FIELDS if part == "results" else schemas.FIXTURE_FIELDS
    return tm.select(
        name("team_key").alias("team_name"),
        F.array(F.struct(*[fields[f].alias(f) for f in names])).alias(part), *_stamped("orders"))


def result_documents(spark, d, name=as_text) -> DataFrame:
    return _match_documents(results(spark, d), "results", {
        "date": casts.format_match_date("match_date"), "opponent": name("match_key"), "side": F.col("home_away"),
        "result": F.col("result_status"), "team_score": as_text("goals_scored"), "opponent_score": as_text("goals_conceded"),
        "team_xg": as_text("xg_for"), "opponent_xg": as_text("xg_against"), "match_link": F.lit("")}, name)


def fixture_documents(spark, d, name=as_text) -> DataFrame:
    return _match_documents(fixtures(spark, d), "fixtures", {
        "date": casts.format_match_date("match_date"), "time": F.col("kickoff"), "opponent": name("match_key"),
        "side": F.col("home_away")}, name)


def league_documents(spark, d, name=as_text) -> DataFrame:
    """One league document per team: cells as text, rank from the distributed league rank."""
    st = ranking.global_row_number(
        standings(spark, d), [F.col("points").desc(), F.col("goal_difference").desc(),
                              F.col("goals_for").desc(), F.col("team_key").asc()], "rank")
    cells = F.array(as_text("rank"), name("team_key"), F.lit(""), *(as_text(c) for c in (
        "matches_played", "wins", "draws", "losses", "goals_for", "goals_against", "points")), F.lit(""), F.lit(""), F.lit(""))
    return st.select(
        F.array(F.struct(name("team_key").alias("Team"), F.lit("").alias("URL"), cells.alias("Data"))).alias("data"),
        *_stamped("orders"))


def player_documents(spark, d, name=as_text) -> DataFrame:
    """One player document per line item: ISO dates, numbers as text, `""` for a missing xG."""
    from .. import schemas
    txt = as_text
    fields = {
        "№": F.lit("1"), "Date": F.date_format("match_date", "yyyy-MM-dd"), "Home": txt("team_key"),
        "Score": F.lit(""), "Away": F.lit(""), "Pos": F.col("position"), "Min": txt("minutes"), "Sh": F.lit(""),
        "G": txt("goals"), "KP": F.lit(""), "A": txt("assists"), "xG": F.coalesce(txt("xg"), F.lit("")),
        "xA": txt("xa")}
    return player_matches(spark, d).select(
        name("player_key").alias("player_name"),
        F.concat(txt("match_key"), F.lit("-"), txt("line_no")).alias("player_url"),
        F.lit(None).cast(schemas.PLAYER_DOC["seasonal_performance"].dataType).alias("seasonal_performance"),
        F.array(F.struct(*[fields[f].alias(f) for f in schemas.MATCH_FIELDS])).alias("match_performance"),
        *_stamped("lineitem"))


def statistics_documents(spark, d, name=as_text) -> DataFrame:
    """One document per team and play type, every figure as text."""
    from .. import schemas
    txt = as_text
    fields = {"№": F.lit("1"), "Situation": F.col("play_type"), "Sh": txt("total_shots"), "G": txt("goals_scored"),
              "ShA": F.lit(""), "GA": F.lit(""), "xG": txt("expected_goals"), "xGA": F.lit(""), "xGD": F.lit(""),
              "xG/Sh": txt("xg_per_shot"), "xGA/Sh": F.lit("")}
    return q_tactics(spark, d).select(
        name("team_key").alias("team_name"),
        F.array(F.create_map(*[x for f in schemas.STAT_FIELDS for x in (F.lit(f), fields[f])])).alias("statistics"),
        *_stamped("lineitem"))


def q_gold_team_summary(spark, d):
    """The gold team summary builder over silver tables built from bronze-style documents."""
    from . import gold, silver
    silver_matches, silver_fixtures = _silver_from_orders(spark, d)
    summary = gold.team_summary(silver.league_standings(league_documents(spark, d)), silver_matches, silver_fixtures)
    return summary.select("rank", "team_name", "matches_played", "wins", "draws", "losses", "points", "goals_for",
                          "goals_against", "goal_difference", F.array_join("form_array", "").alias("form"),
                          "next_opponent", "next_home_away")


def q_gold_player_scoring(spark, d):
    """The silver player-match builder and the gold scoring mart over player documents;
    several lines of one supplier on one day collapse to the latest-wins row, as in the
    silver merge key (player, date)."""
    from . import gold, silver
    return gold.player_scoring_stats(silver.player_matches(player_documents(spark, d)), SEASON_START)


def _silver_from_orders(spark, d):
    """Silver team results and fixtures built from per-order documents (see `_match_documents`)."""
    from . import silver
    return silver.team_matches(result_documents(spark, d)), silver.team_fixtures(fixture_documents(spark, d))


def q_gold_recent_results(spark, d):
    from . import gold
    return gold.recent_results(_silver_from_orders(spark, d)[0])


def q_gold_upcoming_fixtures(spark, d):
    from . import gold
    return gold.upcoming_fixtures(_silver_from_orders(spark, d)[1])


def q_gold_team_match_trends(spark, d):
    from . import gold
    return gold.team_match_trends(_silver_from_orders(spark, d)[0])


def q_gold_team_tactics(spark, d):
    """Statistics documents through the silver statistics builder and the gold tactics mart."""
    from . import gold, silver
    return gold.team_tactics(silver.team_statistics(statistics_documents(spark, d)))


def q_top_scorer_per_team(spark, d):
    pm = player_matches(spark, d).filter(
        (F.col("match_date") >= F.lit(SEASON_START).cast("date")) & (F.col("match_date") < F.lit(AS_OF).cast("date")))
    per_player = pm.groupBy("team_key", "player_key").agg(F.sum("goals").cast("long").alias("goals"))
    return aggregates.top_by(per_player, "team_key", "player_key", "goals", "player_key", "top_scorer")


def q_text_functions(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", text.file_key("p_name").alias("name_key"),
                    text.initials("p_name").alias("initials"), text.code3("p_type").alias("type_code"),
                    text.first_part("p_brand", "#").alias("brand_label"))


QUERIES: dict[str, Query] = {
    "player_scoring_stats": q_player_scoring_stats,
    "team_form_last5": q_team_form_last5,
    "next_fixture": q_next_fixture,
    "team_summary": q_team_summary,
    "match_trends": q_match_trends,
    "tactics": q_tactics,
    "recent_top20": q_recent_top20,
    "upcoming_top20": q_upcoming_top20,
    "leaders_total_goals": _leaders("total_goals"),
    "leaders_xg_performance": _leaders("xg_performance"),
    "squad_sorted": q_squad_sorted,
    "profile_lookup": q_profile_lookup,
    "per90_metrics": q_per90_metrics,
    "zones": q_zones,
    "outcome_labels": q_outcome_labels,
    "similar_items": q_similar_items,
    "last3_chronological": q_last3_chronological,
    "opponent_lookup": q_opponent_lookup,
    "json_flatten": q_json_flatten,
    "explode_tokens": q_explode_tokens,
    "safe_casts": q_safe_casts,
    "upsert_latest": q_upsert_latest,
    "dedupe_latest": q_dedupe_latest,
    "optional_source_default": q_optional_source_default,
    "in_team": q_in_team,
    "orient_sides": q_orient_sides,
    "header_zip": q_header_zip,
    "package_nested": q_package_nested,
    "name_resolution_contains": q_name_resolution_contains,
    "name_resolution_ratio": q_name_resolution_ratio,
    "export_roundtrip": q_export_roundtrip,
    "summary_for_team": q_summary_for_team,
    "top_scorer_per_team": q_top_scorer_per_team,
    "silver_team_matches": q_silver_team_matches,
    "gold_team_summary": q_gold_team_summary,
    "gold_player_scoring": q_gold_player_scoring,
    "gold_team_tactics": q_gold_team_tactics,
    "gold_team_match_trends": q_gold_team_match_trends,
    "gold_recent_results": q_gold_recent_results,
    "gold_upcoming_fixtures": q_gold_upcoming_fixtures,
    "text_functions": q_text_functions,
}


# The reference's six gold marts, as built by `plans/gold.py` (bench headline).
GOLD_MARTS = ("gold_player_scoring", "gold_team_summary", "gold_team_match_trends", "gold_team_tactics",
              "gold_recent_results", "gold_upcoming_fixtures")

# SURVEY §2 operator IDs each registered query exercises.
COVERS: dict[str, str] = {
    "player_scoring_stats": "SRC6 JN7 FLT3 AGG1 AGG2 AGG3 AGG4 AGG5 PRJ6 PRJ7",
    "team_form_last5": "WIN2 FLT6 AGG6 SC1",
    "next_fixture": "WIN1 FLT6 ING2",
    "team_summary": "Q-SUM JN1 JN2 PRJ11 ORD1 WIN1 WIN2 AGG6 (rank: distributed row number)",
    "match_trends": "Q-TREND PRJ12 ORD2",
    "tactics": "Q-TAC PRJ11 SC16 AGG1 SC3",
    "recent_top20": "Q-REC FLT4 ORD3",
    "upcoming_top20": "Q-UP FLT4 ORD3",
    "leaders_total_goals": "Q-API4 ORD4 WIN3",
    "leaders_xg_performance": "Q-API4 ORD4 WIN3",
    "squad_sorted": "Q-UI2 FLT7 ORD5",
    "profile_lookup": "Q-API3 FLT8 SC8 FLT11",
    "per90_metrics": "Q-UI3 SC12 SC13 SC3",
    "zones": "Q-UI1 SC14 WIN3",
    "outcome_labels": "Q-UI2 Q-UI6 SC15 SC18 SC9 SC10 SC11",
    "similar_items": "Q-UI4 FLT10 SET2",
    "last3_chronological": "Q-UI2 WIN4 ORD6",
    "opponent_lookup": "Q-UI1 JN4",
    "json_flatten": "SC20 PRJ2 PRJ6",
    "explode_tokens": "PRJ1 PRJ4 SC19",
    "safe_casts": "PRJ6 PRJ7 PRJ8 PRJ9 SC11",
    "upsert_latest": "SNK2 SNK4 SET1 SET3 JN6 JN7",
    "dedupe_latest": "SET1 SNK4",
    "optional_source_default": "SC17 JN2",
    "in_team": "JN8",
    "orient_sides": "ING1 ING2",
    "header_zip": "ING3 PRJ6 PRJ7",
    "package_nested": "ING5 PRJ1",
    "name_resolution_contains": "FZ1 FZ2 FZ4 FZ5 JN5 SC5 SC22",
    "name_resolution_ratio": "FZ1 FZ3 FZ5 UDF1 SC5",
    "export_roundtrip": "SNK5",
    "summary_for_team": "Q-API2 FLT7 FLT11",
    "top_scorer_per_team": "AGG7",
    "silver_team_matches": "Q-MATCH PRJ1 PRJ2 PRJ6 PRJ7 SC11 SNK4",
    "gold_team_summary": "Q-STAND Q-MATCH Q-FIX Q-SUM PRJ4 PRJ8 JN1 JN2 WIN1 WIN2 AGG6 ORD1",
    "gold_player_scoring": "Q-PM Q-PLAY SET1 SNK4 PRJ6 PRJ7 AGG1 AGG2 AGG3 AGG4 AGG5 FLT3 ORD1",
    "gold_team_tactics": "Q-STATS Q-TAC PRJ5 PRJ6 PRJ7 ORD2",
    "gold_team_match_trends": "Q-MATCH Q-TREND PRJ12 ORD2 SC11",
    "gold_recent_results": "Q-MATCH Q-REC FLT4 ORD3 SC11",
    "gold_upcoming_fixtures": "Q-FIX Q-UP FLT4 ORD3 SC11",
    "text_functions": "SC2 SC8 SC9 SC10 ING8",
}


# ---------------------------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------------------------

def _r(expr: str, digits: int = 2) -> str:
    """Spark's `round` on a double: half-up on the double's shortest decimal text
    (2.5894999999999997 -> 2.589, 1.005 -> 1.01), not on its exact binary value."""
    return f"CAST(ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def _int_text(expr: str) -> str:
    """Spark `try_cast(text AS INT)`: integer text only (decimals give null)."""
    return (f"CASE WHEN regexp_full_match(trim({expr}), '[+-]?[0-9]+') "
            f"THEN TRY_CAST(trim({expr}) AS INTEGER) END")


_TM = f"""team_matches AS (
  SELECT *, CASE result_status WHEN 'l' THEN goals_scored + 1 WHEN 'd' THEN goals_scored
                               WHEN 'w' THEN goals_scored - 1 END AS goals_conceded
  FROM (SELECT o_custkey AS team_key, o_orderkey AS match_key, CAST(o_orderdate AS DATE) AS match_date,
               strftime(o_orderdate, '%H:%M') AS kickoff, o_orderpriority AS opponent,
               CASE WHEN o_orderpriority IN ({", ".join(repr(p) for p in HOME_PRIORITIES)}) THEN 'h' ELSE 'a' END
                 AS home_away,
               CASE o_orderstatus WHEN 'F' THEN 'w' WHEN 'O' THEN 'd' WHEN 'P' THEN 'l' END AS result_status,
               {_int_text("substr(o_orderpriority, 1, 1)")} AS goals_scored,
               o_totalprice / 100000 AS xg_for, o_totalprice / 200000 AS xg_against
        FROM orders) t),
results AS (SELECT * FROM team_matches WHERE match_date < DATE '{AS_OF}'),
fixtures AS (SELECT * FROM team_matches WHERE match_date >= DATE '{AS_OF}')"""

_PM = """player_matches AS (
  SELECT l_suppkey AS player_key, o_custkey AS team_key, l_orderkey AS match_key, l_linenumber AS line_no,
         CAST(o_orderdate AS DATE) AS match_date, CAST(l_quantity AS INTEGER) AS minutes,
         CAST(round(l_tax * 100) AS INTEGER) AS goals, CAST(round(l_discount * 100) AS INTEGER) AS assists,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity / 10 END AS xg,
         l_discount * 10 AS xa, l_returnflag AS position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_STATS = f"""stats AS (
  SELECT player_key, count(match_date) AS matches_played,
         CAST(sum(minutes) AS BIGINT) AS total_minutes, CAST(sum(goals) AS BIGINT) AS total_goals,
         CAST(sum(assists) AS BIGINT) AS total_assists,
         {_r("sum(xg)")} AS total_xg, {_r("sum(xa)")} AS total_xa
  FROM player_matches
  WHERE match_date >= DATE '{SEASON_START}' AND match_date < DATE '{AS_OF}'
  GROUP BY player_key),
scoring AS (
  SELECT *, {_r("total_goals - total_xg")} AS xg_performance FROM stats WHERE total_minutes > 0)"""

_FORM = f"""form AS (
  SELECT team_key, string_agg(res, '' ORDER BY rn) AS form FROM (
    SELECT team_key, upper(result_status) AS res,
           row_number() OVER (PARTITION BY team_key ORDER BY match_date DESC, match_key DESC) AS rn
    FROM results WHERE result_status IS NOT NULL) x
  WHERE rn <= {FORM_LENGTH} GROUP BY team_key)"""

_NEXT = """nxt AS (
  SELECT team_key, match_date AS next_date, opponent AS next_opponent, home_away AS next_home_away FROM (
    SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY match_date, match_key) AS rn FROM fixtures) x
  WHERE rn = 1)"""

_SUMMARY = f"""standings AS (
  SELECT c_custkey AS team_key, c_name AS team_name,
         CAST(coalesce(s.mp, 0) AS INTEGER) AS matches_played, CAST(coalesce(s.w, 0) AS INTEGER) AS wins,
         CAST(coalesce(s.dr, 0) AS INTEGER) AS draws, CAST(coalesce(s.l, 0) AS INTEGER) AS losses,
         CAST(coalesce(s.gf, 0) AS INTEGER) AS goals_for, CAST(coalesce(s.ga, 0) AS INTEGER) AS goals_against
  FROM customer LEFT JOIN (
    SELECT team_key, count(*) AS mp, count_if(result_status = 'w') AS w, count_if(result_status = 'd') AS dr,
           count_if(result_status = 'l') AS l, sum(goals_scored) AS gf, sum(goals_conceded) AS ga
    FROM results GROUP BY team_key) s ON c_custkey = s.team_key),
summary AS (
  SELECT row_number() OVER (ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_key) AS rank,
         team_key, team_name, matches_played, wins, draws, losses, points, goals_for, goals_against,
         goal_difference, form, next_opponent, next_home_away
  FROM (SELECT st.*, CAST(wins * 3 + draws AS INTEGER) AS points,
               goals_for - goals_against AS goal_difference, f.form, n.next_opponent, n.next_home_away
        FROM standings st LEFT JOIN form f USING (team_key) LEFT JOIN nxt n USING (team_key)) y)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_EV_LATEST = """SELECT user_id, event_type, event_id, ts, value FROM (
    SELECT user_id, event_type, event_id, ts, value,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events {where}) x WHERE rn = 1"""

ORACLE_SQL: dict[str, str] = {
    "player_scoring_stats": _with(_PM, _STATS) + "SELECT * FROM scoring",
    "team_form_last5": _with(_TM, _FORM) + "SELECT team_key, form FROM form",
    "next_fixture": _with(_TM, _NEXT) + "SELECT * FROM nxt",
    "team_summary": _with(_TM, _FORM, _NEXT, _SUMMARY) + "SELECT * FROM summary",
    "match_trends": _with(_TM) + """SELECT team_key, match_key, match_date, opponent, home_away, result_status,
        goals_scored, goals_conceded, xg_for, xg_against FROM team_matches
        ORDER BY team_key, match_date DESC, match_key DESC""",
    "tactics": f"""SELECT team_key, play_type, goals_scored, expected_goals, total_shots,
        {_r("expected_goals / total_shots", 3)} AS xg_per_shot, {_r("goals_scored - expected_goals")} AS performance,
        CASE WHEN {_r("goals_scored - expected_goals")} > 0 THEN 'over' ELSE 'under' END AS flag
      FROM (SELECT l_suppkey AS team_key,
                   CASE l_returnflag WHEN 'A' THEN 'Open Play' WHEN 'N' THEN 'Set Piece' WHEN 'R' THEN 'Corner' END
                     AS play_type,
                   CAST(sum(CAST(round(l_tax * 100) AS INTEGER)) AS INTEGER) AS goals_scored,
                   {_r("sum(l_quantity / 10)")} AS expected_goals, CAST(count(*) AS INTEGER) AS total_shots
            FROM lineitem
            WHERE l_returnflag IN ('A', 'N', 'R')
            GROUP BY 1, 2) t""",
    "recent_top20": _with(_TM) + f"""SELECT match_date, team_key AS home_team, goals_scored AS home_goals,
        goals_conceded AS away_goals, opponent AS away_team, match_key
      FROM results WHERE home_away = 'h' ORDER BY match_date DESC, match_key DESC LIMIT {RECENT_LIMIT}""",
    "upcoming_top20": _with(_TM) + f"""SELECT match_date AS fixture_date, kickoff AS fixture_time,
        team_key AS home_team, opponent AS away_team, match_key
      FROM fixtures WHERE home_away = 'h' ORDER BY match_date, match_key LIMIT {RECENT_LIMIT}""",
    "leaders_total_goals": _with(_PM, _STATS) + f"""SELECT *, CAST(row_number() OVER (ORDER BY total_goals DESC,
        player_key) AS INTEGER) AS position FROM scoring WHERE total_goals IS NOT NULL
      ORDER BY total_goals DESC, player_key LIMIT {LEADERS_LIMIT}""",
    "leaders_xg_performance": _with(_PM, _STATS) + f"""SELECT *, CAST(row_number() OVER (ORDER BY xg_performance DESC,
        player_key) AS INTEGER) AS position FROM scoring WHERE xg_performance IS NOT NULL
      ORDER BY xg_performance DESC, player_key LIMIT {LEADERS_LIMIT}""",
    "squad_sorted": f"""SELECT s_suppkey, s_name, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
      WHERE lower(n_name) = '{SELECTED_NATION.lower()}' ORDER BY s_acctbal DESC NULLS LAST, s_suppkey
      LIMIT {SQUAD_LIMIT}""",
    "profile_lookup": f"""SELECT c_custkey, c_name, c_acctbal FROM customer
      WHERE lower(regexp_replace(c_name, '[-#]', ' ', 'g')) = '{SELECTED_SLUG.lower().replace("-", " ")}'
      ORDER BY c_custkey LIMIT 1""",
    "per90_metrics": _with(_PM, _STATS) + f"""SELECT player_key, total_minutes,
        {_r("CAST(total_goals AS DOUBLE) / greatest(total_minutes, 1) * 90")} AS goals_per90,
        {_r("CAST(total_assists AS DOUBLE) / greatest(total_minutes, 1) * 90")} AS assists_per90,
        least(CAST(total_goals AS DOUBLE) / 15.0::DOUBLE * 100, 100.0::DOUBLE) AS goals_pct,
        least(total_xg / 15.0::DOUBLE * 100, 100.0::DOUBLE) AS xg_pct
      FROM scoring""",
    "zones": """SELECT s_suppkey, s_name, rank,
        CASE WHEN rank <= 4 THEN 'top' WHEN rank > n - 3 THEN 'bottom' ELSE 'mid' END AS zone
      FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank,
                   count(*) OVER () AS n FROM supplier) t""",
    "outcome_labels": _with(_TM) + """SELECT team_key, match_key,
        CASE WHEN goals_scored > goals_conceded THEN 'W' WHEN goals_scored < goals_conceded THEN 'L' ELSE 'D' END
          AS outcome,
        CASE WHEN home_away = 'h' THEN 'HOME' ELSE 'AWAY' END AS side,
        upper(substr(substr(opponent, 3), 1, 3)) AS code,
        split_part(strftime(match_date, '%b %-d, %Y'), ',', 1) AS date_label
      FROM team_matches""",
    "similar_items": f"""WITH sel AS (SELECT p_type FROM part WHERE p_partkey = {SELECTED_PART}),
      c AS (SELECT p.p_partkey, p.p_name, p.p_type,
                   CASE WHEN p.p_type = (SELECT p_type FROM sel) THEN 0 ELSE 1 END AS b,
                   CASE WHEN p.p_type = (SELECT p_type FROM sel) THEN NULL ELSE p.p_name END AS w
            FROM part p WHERE p.p_partkey IS DISTINCT FROM {SELECTED_PART})
      SELECT p_partkey, p_name, p_type, CAST(slot AS INTEGER) AS slot, b = 0 AS same_group FROM (
        SELECT *, row_number() OVER (ORDER BY b, w NULLS FIRST, p_partkey) AS slot FROM c) t
      WHERE slot <= {SIMILAR_LIMIT}""",
    "last3_chronological": _with(_TM) + f"""SELECT team_key, match_key, match_date, result_status,
        CAST(count(*) OVER (PARTITION BY team_key) - rn + 1 AS INTEGER) AS pos
      FROM (SELECT team_key, match_key, match_date, result_status,
                   row_number() OVER (PARTITION BY team_key ORDER BY match_date DESC, match_key DESC) AS rn
            FROM results) t WHERE rn <= {LAST_K}""",
    "opponent_lookup": _with(_PM) + """SELECT pm.match_key, pm.line_no, pm.team_key, pm.player_key,
        nc.n_name AS team_badge, ns.n_name AS opponent_badge
      FROM player_matches pm
      LEFT JOIN customer c ON pm.team_key = c.c_custkey LEFT JOIN nation nc ON c.c_nationkey = nc.n_nationkey
      LEFT JOIN supplier s ON pm.player_key = s.s_suppkey LEFT JOIN nation ns ON s.s_nationkey = ns.n_nationkey""",
    "json_flatten": """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
        to_json({'k': CAST(json_extract(props, '$.k') AS INTEGER), 'type': event_type}) AS props_norm
      FROM events""",
    "explode_tokens": """SELECT p_partkey, arr[1] AS first_token, arr[3] AS third_token,
        CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS pos, unnest(arr) AS token
      FROM (SELECT p_partkey, string_split(p_name, ' ') AS arr FROM part) t""",
    "safe_casts": f"""SELECT event_id,
        {_int_text("regexp_extract(props, ':\\s*(\\d+)', 1)")} AS k_int,
        {_int_text("event_type")} AS type_as_int,
        {_int_text("CAST(value AS VARCHAR)")} AS value_as_int,
        CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INTEGER) AS value_trunc,
        TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_back,
        date_trunc('second', ts) AS ts_parsed,
        CAST(ts AS DATE) AS date_roundtrip,
        CAST(ts AS DATE) AS iso_roundtrip,
        CAST(TRY_STRPTIME(event_type, '%b %d, %Y') AS DATE) AS bad_date
      FROM events""",
    "upsert_latest": f"""WITH t AS ({_EV_LATEST.format(where=f"WHERE ts < TIMESTAMP '{UPSERT_SPLIT}'")}),
      s AS ({_EV_LATEST.format(where=f"WHERE ts >= TIMESTAMP '{UPSERT_SPLIT}'")})
      SELECT * FROM s UNION ALL
      SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.event_type = t.event_type)""",
    "dedupe_latest": _EV_LATEST.format(where=""),
    "optional_source_default": _with(_TM, _NEXT) + """SELECT c_custkey,
        coalesce(next_opponent, 'TBD') AS next_opponent, coalesce(next_home_away, 'h') AS next_home_away,
        coalesce(nullif(c_mktsegment, ''), 'Unknown Club') AS club
      FROM customer LEFT JOIN nxt ON c_custkey = nxt.team_key""",
    "in_team": _with(_TM) + f"""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (
        SELECT team_key FROM results WHERE result_status = 'w' AND match_date >= DATE '{SEASON_START}')""",
    "orient_sides": """WITH li AS (SELECT l_orderkey, l_linenumber, l_suppkey AS home, l_partkey AS away,
          CAST(round(l_tax * 100) AS INTEGER) AS hg, CAST(round(l_discount * 100) AS INTEGER) AS ag,
          l_linestatus = 'F' AS played FROM lineitem)
      SELECT l_orderkey, l_linenumber, home AS team, away AS opponent, 'h' AS side,
             CASE WHEN played THEN hg END AS goals_for, CASE WHEN played THEN ag END AS goals_against,
             CASE WHEN played THEN 'played' ELSE 'upcoming' END AS status FROM li
      UNION ALL
      SELECT l_orderkey, l_linenumber, away, home, 'a',
             CASE WHEN played THEN ag END, CASE WHEN played THEN hg END,
             CASE WHEN played THEN 'played' ELSE 'upcoming' END FROM li""",
    "header_zip": """SELECT p_partkey, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price
      FROM part""",
    "package_nested": """SELECT o_orderkey, o_custkey, CAST(count(*) OVER (PARTITION BY o_orderkey) AS INTEGER) AS n_lines,
        l_linenumber AS line_no, l_quantity AS quantity
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "name_resolution_contains": """WITH names AS (
        SELECT DISTINCT lower(trim(n)) AS name FROM (
          SELECT string_split(p_name, ' ')[2] AS n FROM part UNION ALL SELECT p_type FROM part) t),
      choices AS (SELECT lower(trim(p_name)) AS choice, min(p_partkey) AS position FROM part
                  WHERE length(p_name) > 0 GROUP BY 1),
      hits AS (SELECT n.name, arg_min(c.choice, c.position) AS resolved FROM names n JOIN choices c
               ON length(n.name) > 0 AND (contains(c.choice, n.name) OR contains(n.name, c.choice))
               GROUP BY n.name)
      SELECT n.name, coalesce(h.resolved, n.name) AS resolved,
             CASE WHEN h.resolved IS NULL THEN 'none' ELSE 'contains' END AS rule
      FROM names n LEFT JOIN hits h USING (name)""",
    "export_roundtrip": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "summary_for_team": _with(_TM, _FORM, _NEXT, _SUMMARY)
    + f"SELECT * FROM summary WHERE lower(team_name) = '{SELECTED_TEAM.lower()}'",
    "top_scorer_per_team": _with(_PM) + f"""SELECT team_key, player_key AS top_scorer FROM (
        SELECT team_key, player_key, row_number() OVER (PARTITION BY team_key ORDER BY goals DESC NULLS LAST,
               player_key) AS rn
        FROM (SELECT team_key, player_key, CAST(sum(goals) AS BIGINT) AS goals FROM player_matches
              WHERE match_date >= DATE '{SEASON_START}' AND match_date < DATE '{AS_OF}'
              GROUP BY team_key, player_key) g) t
      WHERE rn = 1""",
    "silver_team_matches": _with(_TM) + """SELECT CAST(team_key AS VARCHAR) AS team_name, match_date,
        CAST(match_key AS VARCHAR) AS opponent, home_away, result_status, goals_scored, goals_conceded,
        xg_for, CAST(NULL AS DOUBLE) AS xg_against, match_date AS load_date
      FROM team_matches""",
    "gold_team_summary": _with(_TM, _SUMMARY.split("summary AS (")[0].rstrip().rstrip(","), f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_key) AS rnk
  FROM (SELECT st.*, CAST(wins * 3 + draws AS INTEGER) AS points, goals_for - goals_against AS goal_difference
        FROM standings st) s)""", f"""form_t AS (
  SELECT team_key, string_agg(res, '' ORDER BY rn) AS form FROM (
    SELECT team_key, upper(result_status) AS res,
           row_number() OVER (PARTITION BY team_key ORDER BY match_date DESC, CAST(match_key AS VARCHAR)) AS rn
    FROM results WHERE result_status IS NOT NULL) x
  WHERE rn <= {FORM_LENGTH} GROUP BY team_key)""", """next_t AS (
  SELECT team_key, CAST(match_key AS VARCHAR) AS next_opponent, home_away AS next_home_away FROM (
    SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY match_date, kickoff, CAST(match_key AS VARCHAR)) AS rn
    FROM fixtures) x
  WHERE rn = 1)""") + """SELECT CAST(rnk AS INTEGER) AS rank, CAST(r.team_key AS VARCHAR) AS team_name, matches_played, wins,
        draws, losses, points, goals_for, goals_against, goal_difference, f.form, n.next_opponent, n.next_home_away
      FROM ranked r LEFT JOIN form_t f USING (team_key) LEFT JOIN next_t n USING (team_key)""",
    "gold_player_scoring": _with(_PM, """docs AS (
  SELECT CAST(player_key AS VARCHAR) AS player_name,
         CAST(match_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS url,
         match_date, position, minutes, goals, assists, xg, xa
  FROM player_matches)""", """kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_name, match_date ORDER BY url DESC,
                   position DESC NULLS LAST, minutes DESC NULLS LAST, goals DESC NULLS LAST, assists DESC NULLS LAST,
                   xg DESC NULLS LAST, xa DESC NULLS LAST) AS rn
                 FROM docs) x WHERE rn = 1)""", f"""totals AS (
  SELECT player_name, count(match_date) AS matches_played, CAST(sum(minutes) AS BIGINT) AS total_minutes,
         CAST(sum(goals) AS BIGINT) AS total_goals, CAST(sum(assists) AS BIGINT) AS total_assists,
         {_r("sum(xg)")} AS total_xg, {_r("sum(xa)")} AS total_xa
  FROM kept WHERE match_date >= DATE '{SEASON_START}' GROUP BY player_name)""")
    + f"""SELECT *, {_r("total_goals - total_xg")} AS xg_performance FROM totals WHERE total_minutes > 0""",
    "gold_team_tactics": f"""SELECT CAST(team_key AS VARCHAR) AS team_name, play_type, goals_scored, expected_goals,
        total_shots, {_r("expected_goals / total_shots", 3)} AS xg_per_shot
      FROM (SELECT l_suppkey AS team_key,
                   CASE l_returnflag WHEN 'A' THEN 'Open Play' WHEN 'N' THEN 'Set Piece' WHEN 'R' THEN 'Corner' END
                     AS play_type,
                   CAST(sum(CAST(round(l_tax * 100) AS INTEGER)) AS INTEGER) AS goals_scored,
                   {_r("sum(l_quantity / 10)")} AS expected_goals, CAST(count(*) AS INTEGER) AS total_shots
            FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2) t""",
    "gold_team_match_trends": _with(_TM) + """SELECT CAST(team_key AS VARCHAR) AS team_name, match_date,
        CAST(match_key AS VARCHAR) AS opponent, home_away, result_status, goals_scored, goals_conceded,
        xg_for, xg_against
      FROM results""",
    "gold_recent_results": _with(_TM) + f"""SELECT match_date, CAST(team_key AS VARCHAR) AS home_team,
        goals_scored AS home_goals, goals_conceded AS away_goals, CAST(match_key AS VARCHAR) AS away_team
      FROM results WHERE home_away = 'h'
      ORDER BY match_date DESC, CAST(team_key AS VARCHAR), CAST(match_key AS VARCHAR) LIMIT {RECENT_LIMIT}""",
    "gold_upcoming_fixtures": _with(_TM) + f"""SELECT match_date AS fixture_date, kickoff AS fixture_time,
        CAST(team_key AS VARCHAR) AS home_team, CAST(match_key AS VARCHAR) AS away_team
      FROM fixtures WHERE home_away = 'h'
      ORDER BY match_date, kickoff, CAST(team_key AS VARCHAR), CAST(match_key AS VARCHAR) LIMIT {RECENT_LIMIT}""",
    "text_functions": """SELECT p_partkey, lower(regexp_replace(trim(p_name), ' ', '_', 'g')) AS name_key,
        upper(concat(substr(string_split(trim(p_name), ' ')[1], 1, 1), substr(string_split(trim(p_name), ' ')[2], 1, 1)))
          AS initials,
        upper(substr(p_type, 1, 3)) AS type_code, string_split(p_brand, '#')[1] AS brand_label
      FROM part""",
}
