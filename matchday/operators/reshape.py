"""Ingest reshaping found inside the scraper, as Spark transforms (ING1-ING8).

All are row-local (`Project` / `Generate`), except `nest_by`, whose groups are
bounded by the domain (one team's results in one season: at most 38 rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_key

# Names of cells without a header, `<prefix><0-based cell index>`;
# the team tables use "Column_", the player tables "Col_".
OVERFLOW_PREFIX = "Column_"
SHORT_OVERFLOW_PREFIX = "Col_"


def orient_sides(df: DataFrame, home: str, away: str, home_goals: str, away_goals: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """One fixture row -> two team-perspective rows (ING1).

    Output: team, opponent, side (`h`/`a`), goals_for, goals_against.
    """
    def side(team, opp, s, gf, ga):
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opponent"), F.lit(s).alias("side"),
                        F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"))
    both = F.array(side(home, away, "h", home_goals, away_goals),
                   side(away, home, "a", away_goals, home_goals))
    return df.select(*keep, F.explode(both).alias("_s")).select(*keep, "_s.*")


def orient_by_side(df: DataFrame, side_col: str, pairs: dict[str, tuple[str, str]],
                   home_value: str = "h") -> DataFrame:
    """Team / opponent values from a home / away row, by the row's own side (ING1).

    `pairs` maps an output prefix to (home column, away column); each gives
    `team_<prefix>` and `opponent_<prefix>`.
    """
    is_home = F.col(side_col) == home_value
    cols = []
    for name, (home, away) in pairs.items():
        cols.append(F.when(is_home, F.col(home)).otherwise(F.col(away)).alias(f"team_{name}"))
        cols.append(F.when(is_home, F.col(away)).otherwise(F.col(home)).alias(f"opponent_{name}"))
    return df.select("*", *cols)


def split_played(df: DataFrame, result_col: str) -> tuple[DataFrame, DataFrame]:
    """(played, upcoming) by whether a result is present (ING2)."""
    has = F.col(result_col).isNotNull() & (F.trim(F.col(result_col)) != "")
    return df.filter(has), df.filter(~has | F.col(result_col).isNull())


def zip_headers(headers, cells, overflow_prefix: str = OVERFLOW_PREFIX) -> Column:
    """Map header -> cell; a cell beyond the headers gets `<overflow_prefix><i>`,
    i its 0-based position in the row (ING3). Of a repeated header the last cell counts."""
    h = F.col(headers) if isinstance(headers, str) else headers
    c = F.col(cells) if isinstance(cells, str) else cells
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))),
                        lambda i: F.coalesce(F.get(h, i - 1), F.concat(F.lit(overflow_prefix), (i - 1).cast("string"))))
    names = F.slice(names, 1, F.size(c))
    last = lambda n: F.size(names) - F.array_position(F.reverse(names), n)     # 0-based
    distinct = F.array_distinct(names)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda n: F.get(c, last(n).cast("int"))))


def row_record(cells) -> Column:
    """Row array -> `{Team, URL, Data}` (ING4)."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.struct(F.get(c, 1).alias("Team"), F.get(c, 2).alias("URL"), c.alias("Data"))


def nest_by(df: DataFrame, key: str, part: str, fields: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Package rows into one array per key, optionally ordered (ING5)."""
    rec = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f) for f in fields])
    arr = F.array_sort(F.collect_list(rec)) if order else F.collect_list(rec)
    out = df.groupBy(key).agg(arr.alias(part))
    if order:
        out = out.withColumn(part, F.transform(part, lambda r: F.struct(*[r[f].alias(f) for f in fields])))
    return out


def part_rows(df: DataFrame, key: str, **parts: Column) -> DataFrame:
    """Rows of a tagged union: the key, and one record column for each part, null where a row isn't of that part."""
    return df.select(F.col(key).alias("key"), *[c.alias(name) for name, c in parts.items()])


def package_parts(rows: Sequence[DataFrame], order: dict[str, Sequence[str]], salt: int = 1) -> DataFrame:
    """One document per key with an ordered array for each part (ING5), after a single shuffle.

    `rows` are frames made by `part_rows`; `order` names every part and the fields
    that order its array (all fields settle ties). A key without rows of a part has
    an empty array. A key with very many rows makes a document, and a group, as
    large; with `salt` > 1 its records are dealt to as many documents (`part` 0, 1,
    ...) by their hash.
    """
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    parts = list(order)
    union = union.withColumn("part", F.pmod(F.xxhash64(*parts), F.lit(salt)).cast("int") if salt > 1 else F.lit(0))
    arrays = []
    for p in parts:
        first = F.struct(*[F.col(f"{p}.{f}").alias(f"o{i}") for i, f in enumerate(order[p])])
        entry = F.when(F.col(p).isNotNull(), F.struct(first.alias("at"), F.col(p).alias("record")))
        arrays.append(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["record"]).alias(p))
    return union.groupBy("key", "part").agg(*arrays)


def flatten_roster(df: DataFrame, team_col: str, roster_col: str, name: str = "Player",
                   url: str = "Player_URL") -> DataFrame:
    """(player, url, team) for roster entries that have a URL (ING6)."""
    return (df.select(F.col(team_col).alias("team_name"), F.explode(roster_col).alias("_p"))
            .filter(F.col(f"_p.{url}").isNotNull())
            .select(F.col(f"_p.{name}").alias("player_name"), F.col(f"_p.{url}").alias("player_url"), "team_name"))


def drop_blank_rows(arr, field: str) -> Column:
    """Keep array entries whose `field` is missing or non-blank (ING7)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.filter(c, lambda r: F.coalesce(r[field], F.lit("x")) != "")


def first_k(arr, k: int) -> Column:
    """The first k entries of an array, in source order (ORD7: a season page lists
    at most `k` matches; the source keeps the first 38)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(c, 1, k)


def document_key(c) -> Column:
    """File key from a name (ING8)."""
    return file_key(c)
