"""Ranked lexical search (operator 12): dual-tree search with coordinate maxima.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
lowered. A document's coordinate of a term is (1e9 * tf) div (1000 * tf + 8 * m),
where m grows with its length; an item's is the weight w of each of its terms. The
score is their inner product, in whole numbers.

1. One scan keeps of every document its length and the frequencies of the terms that
   items use, as numbers; document frequencies are aggregated from that.
2. Tasks cut their documents into blocks and build a hierarchy over each: documents
   that share their heaviest terms lie together, a node holds the greatest coordinate
   of every term below it. Items have such a hierarchy too (the union of terms).
3. A pair of an item node and a document node is given up, with all pairs below it,
   when the product of their maxima does not reach the weakest k-th score of the
   node's items; scores are computed for what is left at the leaves.
4. A first round over one in `FIRST` documents (by hash) gives each item a k-th score;
   the second round, over all others, begins with these.

Items are taken in groups of bounded size (`GROUP_ITEMS`, `GROUP_TERMS`), each searched
over all documents, so what tasks hold of the items is bounded. Scores are exact below
2**53, which holds for items of up to 300,000 distinct terms.

Defined results: a null text has no terms; documents without terms count for nothing;
documents that repeat an id are ranked each for itself (ties by the order of rows
within the same id are of no consequence, their rows are equal); a null `doc_id` comes
after all others among equal scores; rows that share an `item_id` (nulls too) are one
item with the terms of all their texts; an item without terms has no rows; empty
tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.tables import read_table
from . import common
from .common import U64, byte_table, ragged, run_hashes, text_buffer

K = 10
GROUP_TERMS = 1_000_000   # (item, term) pairs of a group of items, about
GROUP_ITEMS = 50_000      # items of a group, about
KEPT_TREES = 4            # a task with more item trees than this builds them again for each block
CELLS = 4_000_000         # numbers of a task's table of items
BLOCK_DOCS = 2048         # documents of a block
BLOCK_TERMS = 1_000_000   # its (document, term) pairs, about
LEAF_DOCS = 32
NODE_ITEMS = 8            # items of a lower item node; as many of these make an upper one
FIRST = 8                 # about one in so many documents is searched in the first round
TEXT_BYTES = 4 << 20      # text cut into terms at a time

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, terms before each text)."""
    if not len(buf):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    inside = _TERM[buf]
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    return run_hashes(byte_table(47)[_LOWER[buf]], start, end), np.searchsorted(start, offsets)


def _term_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, term hashes, terms before each row), some megabytes of text each."""
    buf, offsets = text_buffer(column)
    for a, b in common.row_chunks(offsets, TEXT_BYTES):
        h, at = terms(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        yield a, b, h, at


def item_terms(items: DataFrame, id_column: str = "item_id", column: str = "text") -> DataFrame:
    """(item_id, term): the distinct term hashes of each item."""
    def run(batches):
        for batch in batches:
            for a, b, h, at in _term_batches(batch.column(1)):
                row = np.repeat(np.arange(a, b), np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "term"])
    return items.select(F.col(id_column).cast("long").alias("item_id"), F.col(column).alias("text")).mapInArrow(
        run, "item_id long, term long").distinct()


def document_terms(docs: DataFrame, vocabulary, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: places in the sorted `vocabulary` (broadcast hashes), and frequencies."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for a, b, h, at in _term_batches(batch.column(1)):
                n = np.diff(at)
                row = np.repeat(np.arange(b - a), n)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                keys, tf = np.unique(row[hit] * len(known) + place[hit], return_counts=True)
                ends = np.searchsorted(keys // len(known), np.arange(b - a + 1)).astype(np.int32)
                some = np.flatnonzero(n)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.ListArray.from_arrays(ends, (keys % len(known)).astype(np.int32)),
                     pa.ListArray.from_arrays(ends, tf.astype(np.int32))], ["doc_id", "n", "terms", "tfs"])
                yield out if len(some) == b - a else out.take(pa.array(some))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def coordinates(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """The documents' coordinates; `n` is the length of the document that each frequency is of."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 62:
        m = 10 + 90 * n * n_docs // length
    else:
        m = np.array([10 + 90 * int(x) * n_docs // length for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Items:
    """A hierarchy over some items: dense rows over `terms` for the items, nodes of NODE_ITEMS, and nodes of these."""
    ids: np.ndarray           # places of the items
    terms: np.ndarray         # sorted places of the terms
    levels: list[np.ndarray]  # items, nodes, upper nodes


def _ordered(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The rows 0..count-1, those that share their two heaviest columns side by side."""
    by = np.lexsort((cols, -values, rows))
    rows, cols = rows[by], cols[by]
    at = np.searchsorted(rows, np.arange(count))
    n = np.searchsorted(rows, np.arange(count), side="right") - at
    padded = np.append(cols, [-1, -1])
    return np.lexsort((np.where(n > 1, padded[at + 1], -1), np.where(n > 0, padded[at], -1)))


def _grouped_max(x: np.ndarray, size: int) -> np.ndarray:
    return np.maximum.reduceat(x, np.arange(0, len(x), size), axis=0)


def item_trees(owner: np.ndarray, term: np.ndarray, weights: np.ndarray, cells: int = CELLS) -> Iterator[Items]:
    """Hierarchies over items given as (item, term) pairs, cut so that each holds about `cells` numbers.

    `owner` counts from 0 without gaps.
    """
    count = int(owner.max(initial=-1)) + 1
    order = _ordered(owner, term, weights[term], count)
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    by = np.lexsort((term, place[owner]))
    at, t = place[owner][by], term[by]
    bounds = np.searchsorted(at, np.arange(count + 1))
    a = 0
    while a < count:
        b = min(count, a + NODE_ITEMS ** 3)
        while b > a + 1 and (b - a) * len(np.unique(t[bounds[a]:bounds[b]])) > cells:
            b = a + (b - a) // 2
        own = t[bounds[a]:bounds[b]]
        cols = np.unique(own)
        dense = np.zeros((b - a, len(cols)))
        dense[at[bounds[a]:bounds[b]] - a, np.searchsorted(cols, own)] = weights[own]
        nodes = _grouped_max(dense, NODE_ITEMS)
        yield Items(order[a:b], cols, [dense, nodes, _grouped_max(nodes, NODE_ITEMS)])
        a = b


class TopK:
    """The k best (score, row) of each item; `floor` is a k-th score known from elsewhere."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.score = np.zeros((len(floor), k), np.int64)
        self.row = np.full((len(floor), k), -1)

    def least(self) -> np.ndarray:
        """What a score must reach; 1 at least."""
        return np.maximum(np.maximum(self.score[:, -1], self.floor), 1)

    def add(self, items: np.ndarray, scores: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
        """Offer the documents `rows` (columns of `scores`) to `items`; smaller `key[row]` goes first among equals."""
        i, c = np.nonzero(scores >= self.least()[items][:, None])
        if not len(i):
            return
        old_i, old_c = np.nonzero(self.row[items] >= 0)
        score = np.concatenate([scores[i, c], self.score[items][old_i, old_c]])
        row = np.concatenate([rows[c], self.row[items][old_i, old_c]])
        i = np.concatenate([i, old_i])
        by = np.lexsort((key[row], -score, i))
        i, score, row = i[by], score[by], row[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        self.score[items[i[top]], rank[top]] = score[top]
        self.row[items[i[top]], rank[top]] = row[top]


def _dense(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[rows, cols] = values
    return out


def search_block(trees: Iterable[Items], ends: np.ndarray, term: np.ndarray, value: np.ndarray, key: np.ndarray, best: TopK,
                 leaf: int = LEAF_DOCS) -> int:
    """Dual-tree search of one block of documents given as rows of (term, coordinate); gives the scores computed.

    Sums are whole numbers below 2**53, so products of doubles are exact.
    """
    count, computed = len(ends) - 1, 0
    order = _ordered(np.repeat(np.arange(count), np.diff(ends)), term, value, count)
    for tree in trees:
        column = np.searchsorted(tree.terms, term)
        known = tree.terms[np.minimum(column, len(tree.terms) - 1)] == term
        for a in range(0, count, leaf * leaf):
            lower = [order[b:b + leaf] for b in range(a, min(a + leaf * leaf, count), leaf)]
            leaves, maxima = [], []
            for own in lower:
                at = ragged(ends[own], ends[own + 1] - ends[own])
                row = np.repeat(np.arange(len(own)), ends[own + 1] - ends[own])
                use = known[at]
                at, row = at[use], row[use]
                cols, place = np.unique(column[at], return_inverse=True)
                dense = _dense(row, place, value[at], (len(own), len(cols)))
                leaves.append((cols, dense))
                maxima.append(dense.max(0, initial=0))
            # the upper document node against the upper item nodes
            cols, place = np.unique(np.concatenate([c for c, _ in leaves]), return_inverse=True)
            top = np.zeros(len(cols))
            np.maximum.at(top, place, np.concatenate(maxima))
            weakest = best.least()[tree.ids]
            nodes = np.arange(len(tree.levels[2]))
            nodes = nodes[tree.levels[2][:, cols] @ top >= np.minimum.reduceat(weakest, nodes * NODE_ITEMS ** 2)]
            below = ragged(nodes * NODE_ITEMS, np.minimum(NODE_ITEMS, len(tree.levels[1]) - nodes * NODE_ITEMS))
            for own, (cols, dense), peak in zip(lower, leaves, maxima):
                if not len(below) or not len(cols):
                    continue
                # the leaf against lower item nodes, then against their items
                weakest = best.least()[tree.ids]
                least = np.minimum.reduceat(weakest, np.arange(0, len(weakest), NODE_ITEMS))
                some = below[tree.levels[1][np.ix_(below, cols)] @ peak >= least[below]]
                items = ragged(some * NODE_ITEMS, np.minimum(NODE_ITEMS, len(weakest) - some * NODE_ITEMS))
                if not len(items):
                    continue
                rows = tree.levels[0][np.ix_(items, cols)]
                reach = rows @ peak >= weakest[items]
                items, rows = items[reach], rows[reach]
                if len(items):
                    scores = np.rint(rows @ dense.T).astype(np.int64)
                    computed += scores.size
                    best.add(tree.ids[items], scores, own, key)
    return computed


FOUND = "item int, doc_id long, score long"


def _search(shared, k: int, n_docs: int, length: int, floor: np.ndarray):
    """The search of a task's documents, block by block."""
    def blocks(batches) -> Iterator[pa.RecordBatch]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            a = 0
            while a < len(batch):
                room = np.searchsorted(np.cumsum(sizes[a:]), BLOCK_TERMS - entries, side="right")
                b = min(len(batch), a + max(int(min(room, BLOCK_DOCS - docs)), 0 if held else 1))
                if b > a:
                    held.append(batch.slice(a, b - a))
                    docs += b - a
                    entries += int(sizes[a:b].sum())
                if b < len(batch):
                    yield held
                    held, docs, entries = [], 0, 0
                a = b
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, term, weights = shared.value
        trees = list(islice(item_trees(owner, term, weights), KEPT_TREES + 1))
        known = floor.copy()
        for held in blocks(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            ids, n = table["doc_id"].combine_chunks(), table["n"].to_numpy()
            lists, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
            ends = lists.offsets.to_numpy().astype(np.int64)
            t, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
            ends = ends - ends[0]
            value = coordinates(tf, np.repeat(n, np.diff(ends)), n_docs, length)
            key = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            best = TopK(known, k)
            search_block(trees if len(trees) <= KEPT_TREES else item_trees(owner, term, weights), ends, t, value, key, best)
            known = np.maximum(known, best.score[:, -1])
            i, c = np.nonzero(best.row >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), ids.take(pa.array(best.row[i, c])), pa.array(best.score[i, c])],
                                             ["item", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, group_terms: int = GROUP_TERMS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of `docs(doc_id, text)` for each of `items(item_id, text)`."""
    spark = docs.sparkSession
    every = common.stored(item_terms(items), "items")
    n_pairs, n_items = every.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()
    groups = max(1, -(-n_pairs // group_terms), -(-n_items // group_items))
    every = every.withColumn("group", F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(groups)))
    out = None
    for g in range(groups):
        part = _search_group(docs, every.filter(F.col("group") == g).select("item_id", "term").toArrow(), k)
        if part is not None:
            out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _search_group(docs: DataFrame, pairs: pa.Table, k: int) -> DataFrame | None:
    """The search for a group of items, whose (item_id, term) pairs are on the driver."""
    spark = docs.sparkSession
    if not len(pairs):
        return None
    names = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    owner, ids = names.indices.to_numpy(), names.dictionary.to_pylist()
    hashes, term = np.unique(pairs["term"].combine_chunks().to_numpy().view(U64), return_inverse=True)
    rows = common.stored(document_terms(docs, spark.sparkContext.broadcast(hashes)), "frequencies")
    n_docs, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(hashes), np.int64)
    counted = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()   # group_terms rows at most
    for t, df in zip(counted["t"].to_pylist(), counted["df"].to_pylist()):
        weights[t] = weight(n_docs, df)
    shared = spark.sparkContext.broadcast((owner, term, weights))

    early = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0

    def found(which, floor: np.ndarray) -> DataFrame:
        return rows.filter(which).mapInArrow(_search(shared, k, n_docs, length, floor), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    some = common.stored(ranked(found(early, np.zeros(len(ids), np.int64))).select("item", "doc_id", "score", "rank"), "first")
    floor = np.zeros(len(ids), np.int64)
    for r in some.filter(F.col("rank") == k).select("item", "score").collect():      # one row per item of the group
        floor[r["item"]] = r["score"]
    best = ranked(some.drop("rank").union(found(~early, floor)))
    table = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return best.join(F.broadcast(table), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
