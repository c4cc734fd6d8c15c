"""Similarity join (operator 3): documents whose sets of word n-grams overlap enough, by T-occurrence search.

Texts are lower-cased (A-Z) and split at ASCII white space; the set of a text
holds the hashes of its five-word shingles (the whole sequence, if shorter).
Two texts link when `100 * intersection >= percent * union`. A linked text must
hold at least T = ceil(percent * size) shingles of the other.

1. Texts with equal sets are one class from here on.
2. All shingles get one order, frequent ones last, the most frequent at the end
   (as a sample of the rows has them; no result depends on it). Linked classes share
   at least `SHARED` shingles among the first `size - T + SHARED` of each. These
   shingles are the keys of inverted lists; a list of one class is dropped.
3. Pairs in short lists are counted; pairs that can't reach `SHARED` go. Classes
   in a long list are tied to its least class instead of to each other. What
   hangs together this way can be linked; everything else can't.
4. Such groups are searched in tasks of bounded size. A group that exceeds it is
   cut by set size (sizes of linked sets differ by a quarter at most) and by
   hash, and every pair of blocks that may hold links meets in one task.
5. In a task, each set asks the inverted lists of the block: short lists are
   merged by counting, long ones are probed by binary search for the candidates
   whose count can still reach T (DivideSkip). Of the links found, those that
   join what isn't yet joined are handed on, never all pairs of a group.
6. Components of the links, over classes, then over documents.

Defined results: a null text counts as empty; texts without words have no
shingles and link with nothing; rows with equal sets link; `component_id` is the
least `doc_id` of the component, where null ids count only if there is no other;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import common
from .common import U64, byte_table, mix, run_hashes, text_buffer
from .graph import components

WORDS = 5
PERCENT = 80
SHARED = 12                   # shared shingles asked for in step 2
SHORT_LIST = 32               # longer lists are tied, not paired
SAMPLE = 8                    # one row in so many is counted for the order of shingles
HOT_LIST = 32                 # shingles more frequent than this, by the sample, are put last in the order
HOT_KEPT = 1_000_000          # as many of them, the most frequent (nine bytes each in a broadcast)
RANGES = 1024                 # of hashes, counted apart
BLOCK_SHINGLES = 1_500_000    # shingles of a block in a task
PROBED = 3000                 # lists above this length are probed, not merged
_NO_ID = -(1 << 63)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(offsets) - 1
    if not len(buf):
        return [np.zeros(0, U64)] * n
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    ws = _WS[buf]
    start = np.flatnonzero(~ws & (np.concatenate([[True], ws[:-1]]) | first[:-1]))
    end = np.flatnonzero(~ws & (np.concatenate([ws[1:], [True]]) | first[1:])) + 1
    h = run_hashes(byte_table(31)[_LOWER[buf]], start, end)
    at = np.searchsorted(start, offsets)           # words before each text
    count = np.diff(at)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = common.ragged(at[:-1], shingles)
    stop = np.minimum(begin + words, np.repeat(at[1:], shingles))
    s = run_hashes(h, begin, stop)
    cut = np.concatenate([[0], np.cumsum(shingles)])
    out = []
    for i in range(n):
        own = np.sort(s[cut[i]:cut[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


def class_of(own: np.ndarray) -> int:
    """A hash of the whole set."""
    with np.errstate(over="ignore"):
        h = np.array([mix(own + U64(0x632BE59BD9B4E019)).sum(dtype=U64) + U64(len(own)) * U64(0x9E3779B97F4A7C15)], U64)
    return int(mix(h).view(np.int64)[0])


def packed(own: np.ndarray) -> bytes:
    """A set's hashes without their two lowest bytes, six bytes each."""
    return own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(">u8").astype(U64)


def least_overlap(size, percent: int = PERCENT):
    """T: shingles of a set of this size that a linked set must hold."""
    return -(-size * percent // 100)


def _batches(batches: Iterator[pa.RecordBatch], column: int):
    """(sub-batch, its shingle sets), about a megabyte of text each."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(column))
        for a, b in common.row_chunks(offsets, 1 << 20):
            yield batch.slice(a, b - a), shingle_sets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def _classes(batches):
    """(did, class, size) of each text."""
    for batch, sets in _batches(batches, 1):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64())], ["did", "class", "size"])


def cells_of(shingles: np.ndarray) -> np.ndarray:
    """The upper 42 bits of hashes: what is counted (range, and 32 bits in it)."""
    return shingles >> U64(22)


def _sampled(batches):
    """(range, cells, many, times): the cells of a range, four bytes each, and which of them came more than once."""
    def dealt(held):
        cells, times = np.unique(cells_of(np.concatenate(held)), return_counts=True)
        at = np.searchsorted(cells, np.arange(RANGES + 1, dtype=U64) << U64(32)).tolist()
        low, times = cells.astype("<u4"), times.astype("<u4")
        rows = []
        for r, (i, j) in enumerate(zip(at, at[1:])):
            if i < j:
                many = times[i:j] > 1
                rows.append((r, low[i:j].tobytes(), low[i:j][many].tobytes(), times[i:j][many].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                          ["range", "cells", "many", "times"])
    held, size = [], 0
    for _, sets in _batches(batches, 0):
        held.extend(sets)
        size += sum(map(len, sets))
        if size > 2_000_000:
            yield dealt(held)
            held, size = [], 0
    if size:
        yield dealt(held)


def _counted_cells(least: int):
    """(cell, grade) of the cells of a range that occur more than `least` times by the sample; the grade grows with the logarithm."""
    def run(table: pa.Table) -> pa.Table:
        cells, many, times = (np.frombuffer(b"".join(table[c].to_pylist()), "<u4") for c in ("cells", "many", "times"))
        low, n = np.unique(cells, return_counts=True)
        np.add.at(n, np.searchsorted(low, many), times.astype(np.int64) - 1)
        often = n * SAMPLE > least
        grade = np.minimum(255, 1 + 8 * np.log2(n[often] * SAMPLE / least)).astype(np.int32)
        start = U64(table["range"][0].as_py()) << U64(32)
        return pa.table({"cell": (low[often].astype(U64) + start).view(np.int64), "grade": grade})
    return run


def frequent_cells(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells, grades) of the most frequent shingles of `rows(text)`, `HOT_KEPT` at most, in order of cell."""
    sample = rows.filter(F.pmod(F.monotonically_increasing_id(), F.lit(SAMPLE)) == 0).select("text")
    found = common.stored(sample.mapInArrow(_sampled, "range int, cells binary, many binary, times binary")
                          .groupBy("range").applyInArrow(_counted_cells(HOT_LIST), "cell long, grade int"), "frequent")
    left, least = HOT_KEPT, 256
    for grade, n in sorted(map(tuple, found.groupBy("grade").agg(F.count(F.lit(1))).collect()), reverse=True):     # 255 rows at most
        left -= n
        if left < 0:
            break
        least = grade
    kept = found.filter(F.col("grade") >= least).toArrow()
    cells, grades = kept["cell"].to_numpy().view(U64), kept["grade"].to_numpy().astype(np.uint8)
    order = np.argsort(cells)
    return cells[order], grades[order]


def _postings(frequent, percent: int, shared: int):
    """(shingle, class, size, hot) of the shingles that come first in each set; hot: among the frequent ones."""
    def run(batches):
        cells, grades = frequent.value
        for _, sets in _batches(batches, 0):
            keys, owner, sizes, flags = [], [], [], []
            flat = np.concatenate(sets)
            every = np.zeros(len(flat), np.uint8)
            if len(cells):
                at = np.minimum(np.searchsorted(cells, cells_of(flat)), len(cells) - 1)
                every = np.where(cells[at] == cells_of(flat), grades[at], 0)
            stop = 0
            for s in sets:
                n = len(s)
                grade, stop = every[stop:stop + n], stop + n
                if not n:
                    continue
                k = min(n, n - least_overlap(n, percent) + shared)
                flag = grade > 0
                cold = s[~flag][:k]
                end = s[flag][np.argsort(grade[flag], kind="stable")][:k - len(cold)]
                keys.extend((cold, end))
                owner.append(np.full(k, class_of(s)))
                sizes.append(np.full(k, n))
                flags.append(np.arange(k) >= len(cold))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner)),
                     pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(flags))],
                    ["shingle", "class", "size", "hot"])
    return run


PAIR = "a long, b long, na int, nb int, tied boolean"


def _pairs(short: int, percent: int):
    """Pairs of classes in one short list; for a long list, each class with the list's least (tied).

    Reads a partition's postings in order of shingle, so that a list can be
    finished when the next begins.
    """
    names = [x.split()[0] for x in PAIR.split(", ")]

    def lists(keys, owner, size):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner, size = keys[new], owner[new], size[new]          # copies of a text are one class
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(at, len(keys)))
        long = n > short
        out = []
        for gap in range(1, int(n[~long].max(initial=1))):            # the classes `gap` places apart in their list
            count = np.where(long, 0, np.maximum(n - gap, 0))
            i = common.ragged(at, count)
            j = i + gap
            fit = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
            i, j = i[fit], j[fit]
            out.append((owner[i], owner[j], size[i], size[j], np.zeros(len(i), bool)))
        i = common.ragged(at[long], n[long])
        j = np.repeat(at[long], n[long])
        out.append((owner[i], owner[j], size[i], size[j], np.ones(len(i), bool)))
        a, b, na, nb, tied = (np.concatenate(c) for c in zip(*out))
        flip = (a < b) & ~tied
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(flip, b, a)), pa.array(np.where(flip, a, b)), pa.array(np.where(flip, nb, na), pa.int32()),
             pa.array(np.where(flip, na, nb), pa.int32()), pa.array(tied)], names)

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            whole = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0   # the last list may go on
            if whole:
                yield lists(*(c[:whole] for c in cols))
            rest = [c[whole:] for c in cols]
        if rest is not None and len(rest[0]):
            yield lists(*rest)
    return run


class Joined:
    """Which places hang together: a forest of parents."""

    def __init__(self, n: int):
        self.parent, self.size = np.arange(n), np.ones(n, np.int64)

    def roots(self, places: np.ndarray) -> np.ndarray:
        out = self.parent[places]
        while True:
            up = self.parent[out]
            if np.array_equal(up, out):
                self.parent[places] = out
                return out
            out = up

    def join(self, x: int, y: int) -> bool:
        """False if they were joined already."""
        a, b = self.roots(np.array([x, y])).tolist()
        if a == b:
            return False
        a, b = (a, b) if self.size[a] >= self.size[b] else (b, a)
        self.parent[b] = a
        self.size[a] += self.size[b]
        return True


def _counted(owners: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of the places that occur `least` times or more, at the cost of the entries, not of all n places."""
    if 8 * len(owners) < n:
        who, count = np.unique(owners, return_counts=True)
    else:
        count = np.bincount(owners, minlength=n)
        who = np.flatnonzero(count)
        count = count[who]
    enough = count >= least
    return who[enough], count[enough]


def occurrence_links(ids: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, other: np.ndarray,
                     percent: int = PERCENT, probed: int = PROBED) -> list[tuple[int, int]]:
    """Links between the sets `asked` and the sets `other` (places), as many as join what is linked.

    T-occurrence search: the sets of `other` are inverted; each asked set merges
    its short lists, probes the long ones and keeps who reaches T.
    """
    sizes = np.array([len(s) for s in sets])
    joined = Joined(len(ids))
    if not len(asked) or not len(other):
        return []
    flat = np.concatenate([sets[i] for i in other])
    owner = np.repeat(other, sizes[other])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    keys, length = flat[at], np.diff(np.append(at, len(flat)))
    out = []
    for x in asked.tolist():
        n = int(sizes[x])
        place = np.minimum(np.searchsorted(keys, sets[x]), len(keys) - 1)
        place = place[keys[place] == sets[x]]
        need = least_overlap(n, percent)
        if len(place) < need:
            continue
        place = place[np.argsort(length[place], kind="stable")]
        n_long = min(need - 1, int((length[place] > probed).sum()))
        short, long = place[:len(place) - n_long], place[len(place) - n_long:]
        who, got = _counted(owner[common.ragged(at[short], length[short])], len(ids), max(1, need - n_long))
        may = joined.roots(who) != joined.roots(np.array([x]))
        may &= np.minimum(sizes[who], n) * 100 >= np.maximum(sizes[who], n) * percent
        who, got = who[may], got[may]
        for k in long.tolist():
            if not len(who):
                break
            row = owner[at[k]:at[k] + length[k]]
            got = got + (row[np.minimum(np.searchsorted(row, who), len(row) - 1)] == who)
        linked = who[100 * got >= percent * (n + sizes[who] - got)]
        for y in linked.tolist():
            if joined.join(x, y):
                out.append((int(ids[x]), int(ids[y])))
    return out


def _search(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, side = table["class"].to_numpy(), table["side"].to_numpy()
        _, keep = np.unique(ids, return_index=True)      # rows that agree in id and text come twice
        raw = table["shingles"].combine_chunks().take(pa.array(keep))
        sets = [unpacked(b) for b in raw.to_pylist()]
        ids, side = ids[keep], side[keep]
        every = np.arange(len(ids))
        if (side == 2).any():        # two blocks meet
            found = occurrence_links(ids, sets, every[side == 1], every[side == 2], percent)
        else:
            found = occurrence_links(ids, sets, every, every, percent)
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=schema)
    return run


def _tasks(nodes: DataFrame, block: int, percent: int) -> DataFrame:
    """(class, task, side) for the classes of `nodes(class, size, label)`; a class may take part in several tasks."""
    total = nodes.groupBy("label").agg(F.sum("size").alias("weight"))
    small = total.filter(F.col("weight") <= block)
    n_small = max(1, -(-int(small.agg(F.sum("weight")).first()[0] or 0) // block))
    own = nodes.join(small.select("label"), "label").select(
        "class", F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(n_small)).cast("string")).alias("task"),
        F.lit(0).alias("side"))
    big = nodes.join(total.filter(F.col("weight") > block).select("label"), "label").withColumn(
        "step", F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("long"))
    steps = big.groupBy("label", "step").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts"))
    near = steps.select("label", (F.col("step") - 1).alias("step"), F.col("parts").alias("above")) \
        .join(steps, ["label", "step"], "right")
    near = near.join(steps.select("label", (F.col("step") + 1).alias("step"), F.col("parts").alias("below")),
                     ["label", "step"], "left")
    big = big.join(near, ["label", "step"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))

    def name(step_a, a, step_b, b):
        parts = [F.col("label"), step_a, a, step_b, b]
        return F.concat_ws(":", *(p.cast("string") for p in parts))

    def others(n, make, side):
        n = F.coalesce(n, F.lit(0))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                           lambda p: F.struct(make(p).alias("task"), side(p).alias("side")))
    step, part = F.col("step"), F.col("part")
    same = others(F.col("parts"), lambda p: name(step, F.least(p, part), step, F.greatest(p, part)),
                  lambda p: F.when(p == part, 0).when(part < p, 1).otherwise(2))
    above = others(F.col("above"), lambda p: name(step, part, step + 1, p), lambda p: F.lit(1))
    below = others(F.col("below"), lambda p: name(step - 1, p, step, part), lambda p: F.lit(2))
    cut = big.select("class", F.explode(F.concat(same, above, below)).alias("t")).select("class", "t.task", "t.side")
    return own.union(cut)


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, shared: int = SHARED,
             short: int = SHORT_LIST, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(did, class, size, label) of each row of `docs(doc_id, text)`: its set's hash and size, and its component's label.

    Null without shingles; `did` is `_NO_ID` for a null id.
    """
    if words != WORDS:
        raise ValueError("shingles have five words")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), "text")
    # 1. classes of equal sets
    classes = common.stored(rows.mapInArrow(_classes, "did long, class long, size long"), "classes")
    # 2. inverted lists
    frequent = spark.sparkContext.broadcast(frequent_cells(rows))
    postings = rows.select("text").mapInArrow(_postings(frequent, percent, shared), "shingle long, class long, size int, hot boolean")
    # frequent shingles that come first in few sets have short lists all the same
    hot_rows = common.stored(postings.filter("hot").select("shingle", "class", "size").distinct(), "hot")
    lists = hot_rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("class", "size")).alias("least"))
    long = F.broadcast(common.stored(lists.filter(F.col("n") > short).select("shingle", "least"), "long"))    # a row for more than `short` rows
    hot_long = hot_rows.join(long, "shingle")
    cold = (postings.filter("not hot").select("shingle", "class", "size")
            .union(hot_rows.join(long, "shingle", "left_anti"))
            .repartition(common.shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle", "class"))
    # 3. pairs and ties
    met = common.stored(cold.mapInArrow(_pairs(short, percent), PAIR)
                        .groupBy("a", "b", "na", "nb", "tied").agg(F.count(F.lit(1)).alias("n")), "pairs")
    hot_ties = hot_long.select(
        F.col("class").alias("a"), F.col("least.class").alias("b"), F.col("size").alias("na"), F.col("least.size").alias("nb"))
    ties = met.filter("tied")
    # places of a class in long lists: shared shingles that weren't counted
    hidden = (hot_long.select("class", F.lit(1).alias("n"))
              .union(ties.select(F.col("a").alias("class"), "n"))
              .groupBy("class").agg(F.sum("n").alias("n")))
    need = F.least(F.lit(shared), F.ceil(F.greatest("na", "nb") * percent / 100))
    # a class that meets another in long lists alone must be in enough of them
    bare = F.least(F.lit(shared), F.ceil(F.col("na") * percent / 100))
    paired = (met.filter("not tied")
              .join(hidden.select(F.col("class").alias("a"), F.col("n").alias("ha")), "a", "left")
              .join(hidden.select(F.col("class").alias("b"), F.col("n").alias("hb")), "b", "left")
              .filter(F.col("n") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= need))
    ends = ["a", "b", "na", "nb"]
    tied = (ties.select(*ends).union(hot_ties.select(*ends))
            .join(hidden.select(F.col("class").alias("a"), F.col("n").alias("ha")), "a").filter(F.col("ha") >= bare))
    edges = common.checkpointed(paired.select(*ends).union(tied.select(*ends)))
    sizes = (edges.select(F.col("a").alias("node"), F.col("na").alias("size"))
             .union(edges.select("b", "nb")).groupBy("node").agg(F.first("size").alias("size")))
    nodes = common.checkpointed(components(edges.select("a", "b")).join(sizes, "node")
                                .select(F.col("node").alias("class"), "size", "label"))
    # 4. tasks; one text of each class brings the set
    tasks = _tasks(nodes, block, percent).groupBy("class").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    asked = (tasks.join(classes.filter("class is not null").groupBy("class").agg(F.min("did").alias("did")), "class")
             .groupBy("did").agg(F.collect_list(F.struct("class", "tasks")).alias("wants")))
    schema = "task string, side int, class long, shingles binary"

    def bring(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch, sets in _batches(batches, 0):
            out, size = [], 0
            for s, wants in zip(sets, batch.column(1).to_pylist()):
                own = class_of(s) if len(s) else None
                for want in (w for w in wants if w["class"] == own):
                    raw = packed(s)
                    out.extend((t["task"], t["side"], own, raw) for t in want["tasks"])
                    size += len(raw) * len(want["tasks"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names)
    # 5. search; texts that no task asks for aren't shuffled
    asked = common.stored(asked, "asked")
    wanted = rows.filter(common.maybe_among(asked, "did")(F.col("did")))
    links = (wanted.join(asked, "did").select("text", "wants").mapInArrow(bring, schema)
             .groupBy("task").applyInArrow(_search(percent), "a long, b long"))
    # 6. components
    label = components(links)
    joined = classes.join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn(
        "label", F.coalesce("label", "class"))
    return common.checkpointed(joined)


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs(doc_id, text)`; parameters as for `labelled`."""
    joined = labelled(docs, **parameters)
    doc_id = F.when(F.col("did") != _NO_ID, F.col("did"))
    least = joined.filter("label is not null").groupBy("label").agg(F.min(doc_id).alias("component_id"))
    return (joined.join(least, "label", "left")
            .select(doc_id.alias("doc_id"), F.col("size").alias("n_shingles"),
                    F.when(F.col("label").isNull(), doc_id).otherwise(F.col("component_id")).alias("component_id")))


def _with_class(column: int):
    """Adds to each row the hash of its set, null without shingles."""
    def run(batches):
        for batch, sets in _batches(batches, column):
            own = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "class"])
    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs`: the one with the least `doc_id`.

    It goes by rows, not by ids: rows that share an id but don't link all stay, and
    of linked rows one stays even if their ids are null (null ids come last). Of
    rows with one id and one set of shingles that with the least text stays. Rows
    without shingles link with nothing and stay.
    """
    found = labelled(docs).filter("label is not null")
    key = F.struct(F.when(F.col("did") == _NO_ID, 1).otherwise(0).alias("last"), F.col("did"), F.col("class"))
    groups = found.groupBy("label").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    fate = common.stored(found.select("did", "class", "label").distinct().join(groups, "label").select(
        "did", "class", ((F.col("did") == F.col("first.did")) & (F.col("class") == F.col("first.class"))).alias("stays")), "fate")
    # only rows that may have to go are looked at again and shuffled
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), did.alias("did"),
                       common.maybe_among(fate, "did")(did).alias("may"))
    suspects = rows.filter("may").select("row", "did", F.col("row.text").alias("text"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suspects.schema.fields[1:])
    schema = T.StructType([suspects.schema["row"], *T.StructType.fromDDL(names + ", class long").fields])
    checked = suspects.mapInArrow(_with_class(2), schema).join(fate, ["did", "class"], "left")
    first = Window.partitionBy("did", "class").orderBy(F.col("text").asc_nulls_first())
    kept = (checked.filter("stays").withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
            .union(checked.filter("stays is null").select("row.*")))
    return rows.filter("not may").select("row.*").union(kept)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
