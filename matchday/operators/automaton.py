"""Which strings contain which, by a multi-pattern automaton over blocks of bounded size (JN5, FZ2).

Every string is a pattern once, dealt by the hash of its key: the string itself, or,
if it is longer than `KEY_CHARS`, one window of that many characters. As a text it
goes only to the buckets of its own windows of the other side's key lengths: whatever
it contains is there, so what is dealt grows with the strings and not with the pairs
of blocks. A bucket with many texts or patterns (a short name is in very many) is cut
into parts of about `BLOCK_CHARS` characters, each part of texts beside each of patterns.

A task gets one part of patterns and one of texts, builds an Aho-Corasick automaton
over the patterns and reads every text once, so its work grows with the characters and
the matches. Of each name a task hands on only the first choice in order, so a
one-letter name that is in every choice costs one row per task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.names import ship_by_value

BLOCK_CHARS = 400_000
KEY_CHARS = 32       # of a pattern's key, at most

ship_by_value(__name__)


def _order(position):
    """A position (a number or a struct) as a value that sorts."""
    return tuple(position.values()) if isinstance(position, dict) else (position,)


def first_matches(patterns: list[tuple], texts: list[tuple]) -> dict[str, tuple]:
    """name -> (order, choice, position) of the first choice that contains the name or is contained in it.

    Both lists have (string, side, position); side 0 is a name, 1 a choice.
    """
    import ahocorasick
    tree, best = ahocorasick.Automaton(), {}
    by_string: dict[str, list[tuple]] = {}
    for p in patterns:
        by_string.setdefault(p[0], []).append(p)
    for s, rows in by_string.items():
        tree.add_word(s, rows)
    if not by_string:
        return best
    tree.make_automaton()
    for text, side, position in texts:
        seen = set()
        for _, rows in tree.iter(text):
            for s, other, place in rows:
                if other == side or s in seen:
                    continue
                seen.add(s)
                name, choice, at = (text, s, place) if side == 0 else (s, text, position)
                found = (_order(at), choice, at)
                if name not in best or found[:2] < best[name][:2]:
                    best[name] = found
    return best


def _windows(text: Column, length) -> Column:
    """All substrings of `length` characters (no more than the text has)."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substring(text, i, length))


def _key(s: Column) -> Column:
    """What every string that contains `s` has as a window too: `s`, or its window of least hash."""
    least = F.array_min(F.transform(_windows(s, F.lit(KEY_CHARS)), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    return F.when(F.length(s) <= KEY_CHARS, s).otherwise(least["w"])


def dealt(strings: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(patterns, texts) with their `bucket`: a pattern is in one, a text in those of its windows."""
    of_side: dict[int, list[int]] = {0: [], 1: []}
    for side, n in strings.select("side", F.least(F.length("s"), F.lit(KEY_CHARS))).distinct().collect():    # some 64 rows
        of_side[side].append(n)

    def lengths(side: int) -> Column:
        return F.array(*map(F.lit, sorted(of_side[side]))).cast("array<int>")
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    s = F.col("s")
    other = F.when(F.col("side") == 0, lengths(1)).otherwise(lengths(0))
    own = F.flatten(F.transform(F.filter(other, lambda n: n <= F.length(s)), lambda n: F.transform(_windows(s, n), bucket)))
    return (strings.select("s", "side", "position", bucket(_key(s)).alias("bucket")),
            strings.select("s", "side", "position", F.explode(F.array_distinct(own)).alias("bucket")))


def first_containing(strings: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(name, choice, position): for each name the first choice, by position then text, where one contains the other.

    `strings(s, side, position)` holds distinct non-empty names (side 0) and choices (side 1).
    """
    total = strings.agg(F.sum(F.length("s"))).first()[0] or 0
    patterns, texts = dealt(strings, max(1, -(-total // block_chars)))
    place = strings.schema["position"].dataType.simpleString()
    kind = to_arrow_type(T.StructType.fromDDL(f"position {place}")["position"].dataType)

    def parts(df: DataFrame, name: str) -> DataFrame:
        """(bucket, number of parts): one row per bucket."""
        return df.groupBy("bucket").agg(F.ceil(F.sum(F.length("s")) / block_chars).cast("int").alias(name))
    # buckets with both: a row for so many characters of strings
    cut = F.broadcast(parts(patterns, "n_pattern").join(parts(texts, "n_text"), "bucket"))
    part = lambda n: F.pmod(F.xxhash64("s", F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    patterns = patterns.join(cut, "bucket").select("s", "side", "position", "bucket", part("n_pattern").alias("pattern_part"),
                                                   each("n_text").alias("text_part"))
    # the same columns under names of their own: both sides come from one plan
    texts = texts.join(cut, "bucket").select(F.col("s").alias("t"), F.col("side").alias("t_side"), F.col("position").alias("t_position"),
                                             F.col("bucket").alias("t_bucket"), each("n_pattern").alias("p_part"), part("n_text").alias("t_part"))

    def rows(table: pa.Table, columns: tuple) -> list[tuple]:
        return list(zip(*(table[c].to_pylist() for c in columns))) if len(table) else []

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        best = first_matches(rows(left, ("s", "side", "position")), rows(right, ("t", "t_side", "t_position")))
        return pa.table({"name": pa.array(list(best), pa.string()), "choice": pa.array([b[1] for b in best.values()], pa.string()),
                         "position": pa.array([b[2] for b in best.values()], kind)})
    found = patterns.groupBy("bucket", "pattern_part", "text_part").cogroup(texts.groupBy("t_bucket", "p_part", "t_part")).applyInArrow(
        search, f"name string, choice string, position {place}")
    return (found.groupBy("name").agg(F.min(F.struct("position", "choice")).alias("first"))
            .select("name", "first.choice", "first.position"))
