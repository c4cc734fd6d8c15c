"""Sharding (operator 9): best-fit-decreasing packing of groups of equal texts.

Groups enter, largest first, the bin with the tightest remaining capacity that
still holds them; a balanced tree of remaining capacities finds it. With a
given capacity the number of shards is what that needs; with a given number of
shards the smallest capacity that needs no more is sought by bisection.

With a number of shards the law is `bytes`: groups above 1/16384 of all bytes are items
of their own (there are at most 16384 of them); smaller groups are items together
with others that share their hash, so the items that reach the driver are at
most 2 * 16384, whatever the input. A group above an even shard's bytes is split
into parts by the hash of `doc_id`; all other groups stay whole.

With a capacity the packing itself is spread, and no shard exceeds it unless a single
row does (such a row has a shard alone). Groups above the capacity are cut into pieces
of as many rows as fit; groups of at most 1/256 of it are strung together to
pieces of at most twice that. Ranges of pieces of about 256 capacities each are packed in tasks
of their own, so that at most one shard of a range is left half empty.

Defined results: a null text counts as empty (size 1), and is of one group with the
empty texts; a null `doc_id` is placed like others; repeated rows each take a slot; ties in
`doc_id` share their order's places arbitrarily but are equal rows; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

SHARDS = 16
ITEMS = 1 << 14
GRAIN = 256            # light groups have at most this part of a capacity
RANGE = 256            # capacities that one task packs, about
WINDOW_ROWS = 50_000   # groups or copies that one task strings together, about


@dataclass
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """AVL tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root: _Node | None = None

    @staticmethod
    def _height(n: _Node | None) -> int:
        return n.height if n else 0

    def _update(self, n: _Node) -> None:
        n.height = 1 + max(self._height(n.left), self._height(n.right))

    def _turn(self, n: _Node, left: bool) -> _Node:
        up = n.right if left else n.left
        if left:
            n.right, up.left = up.left, n
        else:
            n.left, up.right = up.right, n
        self._update(n)
        self._update(up)
        return up

    def _balance(self, n: _Node) -> _Node:
        self._update(n)
        lean = self._height(n.left) - self._height(n.right)
        if lean > 1:
            if self._height(n.left.left) < self._height(n.left.right):
                n.left = self._turn(n.left, True)
            return self._turn(n, False)
        if lean < -1:
            if self._height(n.right.right) < self._height(n.right.left):
                n.right = self._turn(n.right, False)
            return self._turn(n, True)
        return n

    def insert(self, key: tuple[int, int]) -> None:
        def go(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = go(n.left)
            else:
                n.right = go(n.right)
            return self._balance(n)
        self.root = go(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def go(n, key):
            if key < n.key:
                n.left = go(n.left, key)
            elif key > n.key:
                n.right = go(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = go(n.right, least.key)
            return self._balance(n)
        self.root = go(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest remaining capacity of at least `size`."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, at_most: int | None = None) -> list[int] | None:
    """Bin of each item; an item above the capacity has a bin alone. None if `at_most` bins don't do."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in order:
        key = tree.tightest(sizes[i])
        if key is None:
            if bins == at_most:
                return None
            key = (max(capacity, sizes[i]), bins)
            bins += 1
        else:
            tree.remove(key)
        out[i] = key[1]
        tree.insert((key[0] - sizes[i], key[1]))
    return out


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing with the smallest capacity, to 1/100000, that needs no more than `shards` bins."""
    total, largest = sum(sizes), max(sizes, default=0)
    low, high = max(-(-total // shards), largest), max(-(-total // shards), largest) + largest
    best = best_fit_decreasing(sizes, high, shards)
    while best is None:        # two items above half of the capacity may need more room
        low, high = high, high * 2
        best = best_fit_decreasing(sizes, high, shards)
    step = max(1, total // shards // 100_000)
    while high - low > step:
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid, shards)
        if got is None:
            low = mid
        else:
            best, high = got, mid
    return best


def _sizes(docs: DataFrame) -> DataFrame:
    """A few numbers of each row, and its text's two hashes; the texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return common.checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text).alias("h1"),
        F.xxhash64(F.lit(2), text).alias("h2"),
        F.monotonically_increasing_id().alias("row")))      # tells equal rows apart


PIECE = ["kind", "p1", "p2", "p3"]


def _pieces(rows: DataFrame, capacity: int) -> DataFrame:
    """`rows` with the piece (PIECE columns) each belongs to; a piece fits the capacity, or is one row."""
    grain = max(1, capacity // GRAIN)
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = common.checkpointed(groups)
    light = groups.filter(F.col("bytes") <= grain)
    buckets = max(1, -(-light.count() // WINDOW_ROWS))
    light = light.withColumn("p1", F.pmod(F.xxhash64("h1"), F.lit(buckets)))
    before = F.sum("bytes").over(Window.partitionBy("p1").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1))
    light = light.select("h1", "h2", F.lit(0).alias("kind"), "p1", F.floor(F.coalesce(before, F.lit(0)) / grain).alias("p2"),
                         F.lit(0).cast("long").alias("salts"), F.lit(0).cast("long").alias("fit"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(capacity) / (F.col("bytes") / F.col("n")))).cast("long")
    heavy = groups.filter(F.col("bytes") > grain).select(
        "h1", "h2", F.when(F.col("bytes") > capacity, 2).otherwise(1).alias("kind"), F.col("h1").alias("p1"), F.col("h2").alias("p2"),
        F.ceil(F.col("n") / WINDOW_ROWS).cast("long").alias("salts"), fit.alias("fit"))
    rows = rows.join(light.union(heavy), ["h1", "h2"])
    rows = rows.withColumn("p3", F.when(F.col("kind") == 2, F.pmod(F.xxhash64("row"), F.col("salts"))).otherwise(0))
    # rows of a group above the capacity have one size: so many of a salt make a piece
    place = F.row_number().over(Window.partitionBy("h1", "h2", "p3").orderBy("doc_id", "row")) - 1
    cut = rows.filter("kind = 2").withColumn(
        "p3", F.shiftleft(F.col("p3"), 32) + F.floor(place / F.col("fit")))
    kept = ["doc_id", "size", "text_crc32", "row", *PIECE]
    return rows.filter("kind <> 2").select(*kept).union(cut.select(*kept))


def shard_to_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, in few shards of at most `capacity` bytes."""
    spark = docs.sparkSession
    if capacity < 1:
        raise ValueError("a shard's capacity is at least 1")
    rows = common.checkpointed(_pieces(_sizes(docs), capacity))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-total // (RANGE * capacity)))
    pieces = rows.groupBy(*PIECE).agg(F.sum("size").alias("bytes")).withColumn("range", F.pmod(F.xxhash64(*PIECE), F.lit(ranges)).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(PIECE, ignore_index=True)
        part["bin"] = best_fit_decreasing(part["bytes"].tolist(), capacity)
        return part[["range", *PIECE, "bin"]]

    packed = common.checkpointed(pieces.groupBy("range").applyInPandas(
        pack, "range int, kind int, p1 long, p2 long, p3 long, bin int"))
    base, first = [], 0
    for r in packed.groupBy("range").agg((F.max("bin") + 1).alias("bins")).orderBy("range").collect():    # two numbers a range
        base.append((r["range"], first))
        first += r["bins"]
    base = spark.createDataFrame(base, "range int, first int")
    placed = rows.join(packed.join(F.broadcast(base), "range").withColumn("shard", F.col("first") + F.col("bin")), PIECE)
    # a shard's rows fit its capacity
    slot = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "text_crc32", "row")).cast("long") - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, items: int = ITEMS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of `docs(doc_id, text)`.

    Give `shards` (their capacity is minimised) or `capacity` (their number is).
    """
    if capacity is not None:
        return shard_to_capacity(docs, capacity)
    spark = docs.sparkSession
    rows = _sizes(docs).drop("row")

    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    room = -(-total // shards)
    least = max(1, total // items)            # a heavy group has more bytes than this: there are fewer than `items`
    heavy = (groups.filter(F.col("bytes") > least)
             .select("h1", "h2", F.when(F.col("bytes") > room, F.lit(True)).otherwise(F.lit(False)).alias("split"),
                     F.least(F.ceil(F.col("bytes") / least), F.lit(items)).cast("int").alias("parts")))
    placed = rows.join(F.broadcast(heavy), ["h1", "h2"], "left").select(
        "doc_id", "size", "text_crc32",
        F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("h1")).alias("g1"),
        F.when(F.col("parts").isNull(), F.pmod(F.col("h1"), F.lit(items))).otherwise(F.col("h2")).alias("g2"),
        F.when(F.col("parts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("part"),
        F.coalesce(F.col("split"), F.lit(False)).alias("split"))
    placed = common.checkpointed(placed)

    # at most 2 * items groups with at most as many parts again
    parts = sorted(tuple(r) for r in placed.groupBy("g1", "g2", "part", "split").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
    sizes: dict[tuple, int] = {}
    for g1, g2, part, split, size, _ in parts:
        item = (g1, g2, part if split else -1)
        sizes[item] = sizes.get(item, 0) + size
    keys = sorted(sizes)
    weights = [sizes[k] for k in keys]
    bins = even_bins(weights, shards)
    where = dict(zip(keys, bins or []))
    filled: dict[int, int] = {}
    plan = []
    for g1, g2, part, split, _, n in parts:
        at = where[g1, g2, part if split else -1]
        plan.append((g1, g2, part, at, filled.get(at, 0)))
        filled[at] = filled.get(at, 0) + n
    plan = spark.createDataFrame(plan, "g1 long, g2 long, part int, shard int, base long")

    order = Window.partitionBy("g1", "g2", "part").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("own", F.row_number().over(order) - 1)
            .join(F.broadcast(plan), ["g1", "g2", "part"])       # bounded by `items`, see above
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir))
