"""Document fingerprints (operator 5): closed syncmers, with Spark's own functions only.

A text is the sequence of its words (parted by spaces, tabs and line ends); a
word of more than 24 characters counts as its characters, and so does a text of
fewer than five words, so that texts without spaces have runs too. A run of five words is a closed syncmer when the least hash among its four inner
pairs of words lies at its first or its last pair. That depends on the run
alone: where a passage is copied, the same runs are chosen, whatever stands
around it. Half of all runs are chosen.

The fingerprint of a text is the 64 least distinct hashes of its syncmers (the
hash of all its words, if it has no syncmer), written in ascending order as
eight hexadecimal digits each. The likeness of two fingerprints is the share of
common hashes among the 64 least of both together, an estimate of the
similarity of the two sets of syncmers.

Each kept hash is an anchor: it comes with the place of its first run in the text.
Positional matching lines two texts up by the anchors they share: `aligned` gives
the shift (place in the second less place in the first) on which most of them
agree, and how many do; a passage that was moved as a whole keeps one shift.

Defined results: a null text counts as empty; the fingerprint of a text without
words is the empty string, and two of these have likeness 1; equal texts have
equal fingerprints; texts follow each other by (`doc_id`, hash of the text),
null ids first, and the first follows the last; a single text follows itself;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

RUN = 5       # words of a run
INNER = 2     # words of an inner substring
KEPT = 64     # hashes of a fingerprint
LONG_WORD = 24    # characters; a longer word counts character by character
_NO_ID = -(1 << 63)


def _bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word of a text."""
    one_space = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")),
                          F.lit("\r"), F.lit(" "))
    long = lambda w: F.char_length(w) > LONG_WORD
    parts = lambda a: F.flatten(F.transform(a, lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))))
    words = _bound(F.filter(F.split(one_space, " "), lambda w: w != ""), lambda a: F.when(F.exists(a, long), parts(a)).otherwise(a))
    return F.transform(words, lambda w: F.xxhash64(w))


def symbols(text: Column, run: int = RUN) -> Column:
    """Hashes of a text's words, or of its characters (white space left out) if there are fewer words than a run has."""
    letters = F.transform(F.filter(F.split(text, ""), lambda c: ~c.isin("", " ", "\t", "\n", "\r")), lambda c: F.xxhash64(c))
    return _bound(word_hashes(text), lambda h: F.when(F.size(h) >= run, h).otherwise(letters))


def syncmers(words: Column, run: int = RUN, inner: int = INNER) -> Column:
    """Places and hashes of the closed syncmers in an array of word hashes."""
    n_inner = run - inner + 1

    def choose(h: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(h) - inner),
                            lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(inner))))

        def among(s: Column) -> Column:
            edge = lambda i: F.least(F.get(s, i), F.get(s, i + (n_inner - 1)))
            middle = lambda i: F.least(*(F.get(s, i + j) for j in range(1, n_inner - 1))) \
                if n_inner > 3 else F.get(s, i + 1)
            at = F.filter(F.sequence(F.lit(0), F.size(s) - n_inner), lambda i: edge(i) <= middle(i))
            return F.transform(at, lambda i: F.struct(
                i.alias("place"), F.hash(*(F.get(h, i + j) for j in range(run))).alias("hash")))
        return _bound(pairs, among)
    empty = F.array().cast("array<struct<place:int,hash:int>>")
    return _bound(words, lambda h: F.when(F.size(h) >= run, choose(h)).otherwise(empty))


def anchors(text: Column, run: int = RUN, inner: int = INNER, kept: int = KEPT) -> Column:
    """The least distinct syncmer hashes of a text, ascending, each with the place of its first run."""
    # one long holds hash and place, so that numbers are sorted
    hash_of = lambda x: F.shiftright(x, 32)

    def first(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (hash_of(F.get(a, i - 1)) != hash_of(x)))

    def least(h: Column) -> Column:
        found = F.transform(syncmers(h, run, inner), lambda x: F.shiftleft(x["hash"].cast("long"), 32).bitwiseOR(x["place"].cast("long")))
        whole = F.array(F.shiftleft(F.hash(h).cast("long"), 32))
        packed = _bound(F.slice(_bound(F.sort_array(found), first), 1, kept),
                        lambda a: F.when((F.size(a) == 0) & (F.size(h) > 0), whole).otherwise(a))
        return F.transform(packed, lambda x: F.struct(hash_of(x).cast("int").alias("hash"),
                                                      x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("place")))
    return _bound(symbols(F.coalesce(text, F.lit("")), run), least)


def hashes_of(found: Column) -> Column:
    """The hashes of anchors, the sketch of a text."""
    return F.transform(found, lambda x: x["hash"])


def sketch(text: Column, run: int = RUN, inner: int = INNER, kept: int = KEPT) -> Column:
    """The least distinct syncmer hashes of a text, ascending."""
    return hashes_of(anchors(text, run, inner, kept))


def aligned(a: Column, b: Column) -> Column:
    """Struct of the shift on which most common anchors agree (the least by size, then value) and their number; null and 0 without any."""
    def shifts(of: Column) -> Column:
        return F.filter(F.transform(a, lambda x: F.try_element_at(of, x["hash"]) - x["place"]), lambda s: s.isNotNull())

    def most(s: Column) -> Column:
        votes = F.transform(F.array_distinct(s), lambda v: F.struct(
            F.size(F.filter(s, lambda w: w == v)).alias("n"), (-F.abs(v)).alias("near"), (-v).alias("back")))
        return _bound(F.array_max(votes), lambda m: F.struct((-m["back"]).alias("shift"), F.coalesce(m["n"], F.lit(0)).alias("anchors")))
    return _bound(_bound(F.map_from_arrays(hashes_of(b), F.transform(b, lambda x: x["place"])), shifts), most)


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, eight for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated similarity of the sets behind two sketches."""
    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))
    return _bound(F.slice(F.sort_array(F.array_union(a, b)), 1, kept), share)


def with_next(rows: DataFrame, carried: list[str], computed: dict[str, Column]) -> DataFrame:
    """`rows(did, tie, ...)` with `next`, a struct of the `carried` columns of the row that follows by (did, tie).

    The `computed` columns are added once the guests are found, so that each row's are computed once.

    Rows are dealt to ranges of `did` and ordered inside each; the first row of
    every range is also placed after the last row of the range before. The
    number of ranges follows the number of shuffle partitions.
    """
    spark = rows.sparkSession
    n = 2 * common.shuffle_partitions(spark)
    points = rows.agg(F.percentile_approx("did", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(points))
    place = F.array(*(F.lit(int(b)) for b in bounds)) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("range", F.size(F.filter(place, lambda b: b < F.col("did"))))
    # one row per range: its first row, and the range before that is not empty (the last for the first)
    firsts = rows.groupBy("range").agg(F.min(F.struct("did", "tie")).alias("first"))
    order = Window.orderBy("range")                                   # n rows at most
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.col("first.did").alias("did"), F.col("first.tie").alias("tie"),
                           F.coalesce(F.lag("range").over(order), F.last("range").over(whole)).alias("before"))
    guests = (rows.join(F.broadcast(firsts), ["range", "did", "tie"])
              .dropDuplicates(["range", "did", "tie"]).withColumn("range", F.col("before")).drop("before")
              .withColumn("guest", F.lit(1)))
    every = rows.withColumn("guest", F.lit(0)).unionByName(guests).withColumns(computed)
    follow = Window.partitionBy("range").orderBy("guest", "did", "tie")
    return (every.withColumn("next", F.lead(F.struct(*carried)).over(follow)).filter("guest = 0")
            .drop("guest", "range"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.documents(spark, sf_dir))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of it with its second half taken from the next text; their likeness."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("tie"),
                       text.alias("body"))
    n = F.char_length("body").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = with_next(rows, ["body", "own"], {"own": anchors(F.col("body"))})
    rows = rows.select(
        F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"), n.alias("n_chars"), "own",
        F.concat(F.substring(F.col("body"), F.lit(1), n.cast("int") - half),
                 F.substring(F.col("next.body"), F.lit(1), half)).alias("edited"),
        F.col("next.own").alias("next_own"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.struct("own", anchors(F.col("edited")).alias("changed"), "next_own").alias("s"))
    # the anchors are computed once and bound, and so are the sketches
    sketches = lambda s: F.struct(hashes_of(s["own"]).alias("own"), hashes_of(s["changed"]).alias("changed"),
                                  hashes_of(s["next_own"]).alias("next_own"), aligned(s["own"], s["changed"]).alias("at"))
    out = _bound(_bound(F.col("s"), sketches), lambda s: F.struct(
        as_text(s["own"]).alias("fingerprint"), as_text(s["changed"]).alias("edited_fingerprint"),
        likeness(s["own"], s["changed"]).alias("near_edited"), likeness(s["own"], s["next_own"]).alias("near_next"),
        s["at"]["shift"].alias("shift_edited"), s["at"]["anchors"].alias("aligned_edited")))
    return rows.select("doc_id", "n_chars", "edited_sha256", out.alias("o")).select(
        "doc_id", "n_chars", "edited_sha256", "o.*")
