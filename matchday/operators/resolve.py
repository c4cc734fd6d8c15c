"""Fuzzy entity resolution (FZ1-FZ6, JN3, JN5).

For each name, with choices in a fixed order (`position`):
  rule 1  the first choice (lowest position) where one string contains the other;
  rule 2  else the choice with the best Ratcliff/Obershelp ratio >= cutoff
          (ties: the larger string, as `difflib.get_close_matches` orders them);
  rule 3  else the name itself.
An empty name matches nothing (Q10); empty choices are ignored likewise.

No name x choice cross product is formed. Both rules get candidates from
exact filters expressed as equi-joins:

* containment, for rule 1: `automaton.first_containing`, one automaton per block of
  strings. All containing pairs (`containment_candidates`), q-gram blocking: if s is inside t and |s| >= q, every q-gram of
  s occurs in t; s is keyed on its rarest q-gram, t on all of its q-grams
  (and on its 1- and 2-grams, for strings shorter than q). Names and choices
  share one gram index, so both directions cost one join. Each candidate is
  then checked with `instr`.
* ratio, prefix filtering: ratio = 2M/(|a|+|b|) and M <= |multiset overlap|.
  With the length filter 2*min/(|a|+|b|) >= t, any qualifying pair overlaps
  in at least ceil(t*|s|/(2-t)) characters of either side, so under one global
  order of (character, occurrence) tokens their short prefixes must share a
  token. Only those pairs reach the Arrow UDF that computes the exact ratio.
Name and choice keys are de-duplicated before any of this and joined back once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicateKeyError
from ..functions.names import clean_names, similarity
from ..session import materialize
from ..sources.documents import POSITION
from .automaton import first_containing

Q = 3
RATIO_CUTOFF = 0.7  # fixed value: `get_close_matches(..., n=1, cutoff=0.7)`


def _grams(s, n: int):
    """Array of all substrings of length n of string column s (empty when shorter)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(0))),
                       lambda i: F.substring(s, i, n))


def containment_candidates(names: DataFrame, choices: DataFrame) -> DataFrame:
    """(name, choice, position) where one string contains the other.

    Inputs hold distinct non-empty strings: `names.name`, `choices.choice`
    (+ `position`). Both directions come out of one gram index over the union
    of the two sides: every string is a container of all its 1-, 2- and
    q-grams, and a pattern keyed by its rarest q-gram (itself when shorter
    than q). One equi-join on the gram gives every containing pair.
    """
    place = choices.schema["position"].dataType
    strings = (names.select(F.col("name").alias("s"), F.lit(0).alias("side"),
                            F.lit(None).cast(place).alias("position"))
               .unionByName(choices.select(F.col("choice").alias("s"), F.lit(1).alias("side"), "position")))
    s = F.col("s")
    allg = F.array_distinct(F.flatten(F.array(_grams(s, 1), _grams(s, 2), _grams(s, Q))))
    containers = strings.select("s", "side", "position",
                                F.explode(F.filter(allg, lambda g: F.length(g) > 0)).alias("gram"))
    freq = containers.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    short = strings.filter(F.length(s) < Q).select("s", "side", "position", s.alias("gram"))
    longp = (strings.filter(F.length(s) >= Q)
             .select("s", "side", "position", F.explode(F.array_distinct(_grams(s, Q))).alias("gram"))
             .join(freq, "gram")
             .groupBy("s", "side", "position")
             .agg(F.min_by("gram", F.struct("freq", "gram")).alias("gram")))
    patterns = short.unionByName(longp)
    p = patterns.select(F.col("s").alias("ps"), F.col("side").alias("pside"),
                        F.col("position").alias("ppos"), "gram")
    c = containers.select(F.col("s").alias("cs"), F.col("side").alias("cside"),
                          F.col("position").alias("cpos"), "gram")
    pairs = (p.join(c, "gram").filter(F.col("pside") != F.col("cside"))
             .filter(F.instr("cs", F.col("ps")) > 0))
    name_is_pattern = F.col("pside") == 0
    return (pairs.select(F.when(name_is_pattern, F.col("ps")).otherwise(F.col("cs")).alias("name"),
                         F.when(name_is_pattern, F.col("cs")).otherwise(F.col("ps")).alias("choice"),
                         F.when(name_is_pattern, F.col("cpos")).otherwise(F.col("ppos")).alias("position"))
            .distinct())


def _tokens(s):
    """Characters tagged with their occurrence number: `aba` -> [a#1, b#1, a#2]."""
    chars = F.filter(F.split(s, ""), lambda c: F.length(c) > 0)
    return F.transform(chars, lambda c, i: F.concat(
        c, F.lit("#"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))


def _prefix_len(s, t: float):
    """|s| - ceil(t*|s|/(2-t)) + 1 tokens (at least 1)."""
    n = F.length(s)
    alpha = F.greatest(F.ceil(n * F.lit(t / (2.0 - t)) - F.lit(1e-9)), F.lit(1))
    return F.greatest(n - alpha + 1, F.lit(1)).cast("int")


def ratio_candidates(names: DataFrame, choices: DataFrame, cutoff: float = RATIO_CUTOFF) -> DataFrame:
    """(name, choice) pairs that can reach `cutoff` (prefix + length filters; exact)."""
    n_tok = names.select(F.col("name").alias("s"), F.lit(0).alias("side"), F.explode(_tokens(F.col("name"))).alias("tok"))
    c_tok = choices.select(F.col("choice").alias("s"), F.lit(1).alias("side"), F.explode(_tokens(F.col("choice"))).alias("tok"))
    toks = n_tok.unionByName(c_tok)
    freq = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    ranked = (toks.join(freq, "tok")
              .withColumn("_r", F.row_number().over(Window.partitionBy("side", "s").orderBy("freq", "tok")))
              .filter(F.col("_r") <= _prefix_len(F.col("s"), cutoff)))
    left = ranked.filter(F.col("side") == 0).select(F.col("s").alias("name"), "tok")
    right = ranked.filter(F.col("side") == 1).select(F.col("s").alias("choice"), "tok")
    pairs = left.join(right, "tok").select("name", "choice").distinct()
    la, lb = F.length("name"), F.length("choice")
    return pairs.filter(F.least(la, lb) * 2 >= F.lit(cutoff) * (la + lb) - F.lit(1e-9))


def resolve_keys(names: DataFrame, choices: DataFrame, cutoff: float | None = RATIO_CUTOFF) -> DataFrame:
    """Resolve distinct cleaned names against ordered choices (FZ2-FZ5).

    names:   column `name` (cleaned, any duplicates)
    choices: columns `choice` (cleaned), `position` (file order: a number or any ordered value)
    returns: name, resolved, rule (`contains` | `ratio` | `none`), score
    `cutoff=None` applies rule 1 and rule 3 only.
    """
    # the distinct name and choice sets feed every branch below: compute them once (one job)
    both = materialize(
        names.select(F.col("name").alias("s"), F.lit(0).alias("side"),
                     F.lit(None).cast(choices.schema["position"].dataType).alias("position"))
        .distinct()
        .unionByName(choices.filter(F.length("choice") > 0)
                     .groupBy("choice").agg(F.min("position").alias("position"))
                     .select(F.col("choice").alias("s"), F.lit(1).alias("side"), "position")))
    nm = both.filter(F.col("side") == 0).select(F.col("s").alias("name"))
    nonempty = nm.filter(F.length("name") > 0)
    ch = both.filter(F.col("side") == 1).select(F.col("s").alias("choice"), "position")
    # rule 1: first containing choice in file order
    r1 = (first_containing(both.filter(F.length("s") > 0))
          .select("name", F.col("choice").alias("resolved"))
          .withColumn("rule", F.lit("contains")).withColumn("score", F.lit(None).cast("double")))
    if cutoff is None:
        return (nm.join(r1, "name", "left")
                .select("name", F.coalesce("resolved", "name").alias("resolved"),
                        F.coalesce("rule", F.lit("none")).alias("rule"), "score"))
    # rule 2: only names that rule 1 did not settle reach the UDF
    rest = nonempty.join(r1.select("name"), "name", "left_anti")
    scored = (ratio_candidates(rest, ch.select("choice"), cutoff)
              .withColumn("score", similarity(F.col("choice"), F.col("name")))
              .filter(F.col("score") >= cutoff))
    r2 = (scored.groupBy("name")
          .agg(F.max_by(F.struct("choice", "score"), F.struct("score", "choice")).alias("_b"))
          .select("name", F.col("_b.choice").alias("resolved"), F.lit("ratio").alias("rule"),
                  F.col("_b.score").alias("score")))
    settled = r1.unionByName(r2)
    return (nm.join(settled, "name", "left")
            .select("name", F.coalesce("resolved", "name").alias("resolved"),
                    F.coalesce("rule", F.lit("none")).alias("rule"), "score"))


def enrich(left: DataFrame, left_name: str, right: DataFrame, right_name: str,
           suffix: str, unique: str = "raise", position: str = POSITION, cutoff: float | None = RATIO_CUTOFF) -> DataFrame:
    """Left-join `right` onto `left` through resolved names (FZ1, FZ5, FZ6, JN3, PRJ13, PRJ15).

    `position` is the column of `right` that holds the file order, as `read_rows`
    gives it; it is not part of the result. Without such a column rows count in
    the order the DataFrame happens to have (small literal lists, not files). `unique`: what to
    do when two right rows share a cleaned key (Q11): `raise`, or `first` (keep the
    first in order). Output keeps every left row exactly once.
    """
    from .nested import suffix_collisions

    r = clean_names(right, right_name, "_key")
    if position not in r.columns:
        r = r.withColumn(position, F.monotonically_increasing_id())
    kept = [c for c in r.columns if c not in (position, "_key")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    # one row per key: the first in file order, all columns settling rows of one place
    r = r.groupBy("_key").agg(F.min(F.struct(F.col(f"`{position}`").alias("at"), row.alias("row"))).alias("first"),
                              F.count(F.lit(1)).alias("n"))
    r = materialize(r.select("_key", "first.at", "first.row", "n"))
    if unique == "raise":
        again = r.filter("n > 1").select("_key").first()
        if again:
            raise DuplicateKeyError(f"enrichment side not unique: {again[0]!r}")
    l = clean_names(left, left_name, "_name")
    keys = resolve_keys(l.select(F.col("_name").alias("name")),
                        r.select(F.col("_key").alias("choice"), F.col("at").alias("position")), cutoff)
    l = l.join(keys.select(F.col("name").alias("_name"), F.col("resolved").alias("_key")), "_name", "left")
    r = suffix_collisions(l, r.select("_key", "row.*"), ["_key"], suffix)
    return l.join(r, "_key", "left").drop("_key", "_name")
