"""Repeated passages (operator 1): suffix arrays and longest-previous-factor arrays over buckets of fragments.

A byte is removed when a string of `min_length` bytes that covers it also
starts elsewhere, in the same text or another. Finding these strings:

1. Every window of `min_length` bytes has a key: the least hash of the short
   strings inside it. The key depends on the window's bytes alone, so equal
   windows have equal keys, wherever they are. Neighbouring windows mostly
   share a key; such a run of windows is a fragment.
2. Keys are counted. A fragment whose key occurs once holds no repeat; most
   fragments go here.
3. Fragments with equal bytes are counted together and their first instance
   (in order of document and position) stands for all.
4. The bytes of those whose key has several different fragments are put into
   buckets by key. In each bucket a suffix array is built, and from it, by the
   previous and next smaller positions in suffix order, whether each window has
   an earlier match (its longest previous factor reaches `min_length`) and where
   that lies: a window has a copy if it has such a match or is one.
5. Keys with too many bytes for one bucket (a frequent line among always other
   neighbours) are decided by counting hashes of their windows instead, with
   partial counts before the shuffle; there is no limit to their number.

`keep="none"` removes all copies of a repeated string, `keep="first"` only the
later ones.

Defined results: a null text counts as empty; rows that agree in `doc_id` and
text are copies of each other like other rows under "none", and both stay under
"first", where nothing tells which is first; null ids are ordered first; an
empty table gives no rows; extra columns pass through `remove_repeats`
unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common
from .common import U64, byte_table, run_hashes, text_buffer

MIN_LENGTH = 200
GRAM = 40                  # bytes of the strings whose least hash is a window's key
BUCKET_BYTES = 1 << 20     # of a suffix array, about; keys with more than twice as much go by window counts
CHUNK = 1 << 20
_NO_ID = -(1 << 63)
_S64 = np.int64


def fragments(buf: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH,
              gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, key, alone) of the fragments; `start` and `end` count from the first byte given.

    `alone`: the key's string lies in the fragment once, so that it can't hold one window twice.
    """
    none = np.zeros(0, np.int64)
    n, gram = len(buf), min(gram, min_length)
    if n < min_length:
        return none, none, none, none.astype(U64), none.astype(bool)
    at = np.arange(n - gram + 1)
    grams = run_hashes(byte_table(21)[buf], at, at + gram)
    least, width, have = grams, min_length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    # least[s] is the key of the window [s, s + min_length)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    inside = np.arange(len(least)) + min_length <= offsets[1:][owner]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(change & inside)
    stop = inside.copy()
    stop[:-1] &= change[1:] | ~inside[1:]
    end = np.flatnonzero(stop) + min_length
    if not len(start):
        return none, none, none, none.astype(U64), none.astype(bool)
    key, length = least[start], end - start - gram + 1
    hits = grams[common.ragged(start, length)] == np.repeat(key, length)
    alone = np.add.reduceat(hits.astype(np.int64), np.cumsum(length) - length) == 1
    return owner[start], start, end, key, alone


def _fragment_rows(min_length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            ids, rows = batch.column(0), batch.column(1)
            for a, b in common.row_chunks(offsets, CHUNK):
                part, own = buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                text, start, end, key, alone = fragments(part, own, min_length, gram)
                if not len(text):
                    continue
                group = batch.column(3).to_numpy()[a + text].view(U64)
                key = np.where(group == 0, key, common.mix(key ^ group))     # equal windows of two groups never meet
                same = run_hashes(byte_table(22)[part], start, end)
                row = pa.array(a + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(_S64)), pa.array(same.view(_S64)), ids.take(row), rows.take(row),
                     pa.array(start - own[text]), pa.array(end - own[text]), pa.array(alone)],
                    ["key", "same", "did", "rid", "lo", "hi", "alone"])
    return run


FRAGMENT = "key long, same long, did long, rid long, lo long, hi long, alone boolean"


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, -1 for none (pointer jumping)."""
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def _ranks(high: np.ndarray, low: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, rank) by pairs of numbers below 2**bits (or by `high` alone)."""
    n = len(high)
    need = max(1, (n - 1).bit_length())
    pair = high if low is None else (high << U64(bits)) | low
    if (bits if low is None else 2 * bits) + need <= 64:     # the position fits beside the pair
        packed = np.sort((pair << U64(need)) | np.arange(n, dtype=U64))
        order = (packed & U64((1 << need) - 1)).astype(np.int64)
        pair = packed >> U64(need)
    else:
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    rank = np.empty(n, U64)
    rank[order] = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])]).astype(U64)
    return order, rank


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of all positions by their first `length` bytes, by prefix doubling."""
    n = len(text)
    known = min(4, length)
    first = np.zeros(n, U64)
    for i in range(known):
        byte = np.zeros(n, U64)
        byte[:n - i] = text[i:]
        first = (first << U64(8)) | byte
    order, rank = _ranks(first, None, 32)
    while known < length:
        step = min(known, length - known)      # the first `known` and, `step` later, `known` bytes again
        later = np.zeros(n, U64)
        later[:n - step] = rank[step:]
        order, rank = _ranks(rank, later, max(1, n.bit_length()))
        known += step
    return order, rank


def repeated_windows(pieces: list[bytes], min_length: int, part: np.ndarray | None = None,
                     page: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, position, has an earlier match, has any match) of each window of the pieces, in order.

    With `part`, only pieces of equal parts match; with `page`, a match is any in a piece of another page.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    order, rank = suffix_order(text, min_length)
    whole = np.arange(len(text)) + min_length <= offsets[1:][owner]
    order = order[whole[order]]
    r = rank[order]
    if part is not None:
        names = np.unique(part, return_inverse=True)[1]
        r = r * U64(len(part)) + names[owner[order]].astype(U64)
        again = np.argsort(r, kind="stable")
        order, r = order[again], r[again]
    # longest previous factor, cut at min_length: the match at the previous or next smaller position
    # in suffix order counts as far as both lie in one run of suffixes that agree in min_length bytes
    before = _smaller_before(order)
    after = len(order) - 1 - _smaller_before(order[::-1])[::-1]
    to_before = (before >= 0) & (r[before] == r)
    to_after = after < len(order)
    to_after[to_after] = r[after[to_after]] == r[to_after]
    earlier = np.zeros(len(text), bool)
    earlier[order] = to_before | to_after
    # of equal windows only the first has no earlier match; another's match lies at it
    several = earlier.copy()
    several[order[before[to_before]]] = True
    several[order[after[to_after]]] = True
    if page is not None and len(order):
        run = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        at = page[owner[order]]
        several[order] = np.repeat(np.minimum.reduceat(at, run) != np.maximum.reduceat(at, run),
                                   np.diff(np.append(run, len(order))))
    at = np.flatnonzero(whole)
    return owner[at], at - offsets[owner[at]], earlier[at], several[at]


def _spans(group: np.ndarray, position: np.ndarray, hit: np.ndarray, min_length: int):
    """(group, start, end) of the maximal runs that the hit windows cover; positions ascend in each group."""
    g, p = group[hit], position[hit]
    if not len(g):
        return g, p, p
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] > p[:-1] + min_length)])
    last = np.concatenate([new[1:], [True]])
    return g[new], p[new], p[last] + min_length


def _bucket_spans(min_length: int, keep: str, across: bool):
    schema = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def scan(table: pa.Table) -> pa.Table:
        place = [table[c].to_numpy() for c in ("did", "rid", "lo")]
        order = np.lexsort(place[::-1])
        # rows that agree in id and text ask twice for the same bytes
        order = order[np.concatenate([[True], np.any([p[order][1:] != p[order][:-1] for p in place], axis=0)])]
        did, rid, lo = (p[order] for p in place)
        pieces = table["bytes"].take(pa.array(order)).to_pylist()
        # keys of a bucket share no window (but in two groups), so all their fragments can stand in one text
        key = table["key"].to_numpy()[order]
        piece, at, earlier, several = repeated_windows(pieces, min_length, *((key, did) if across else ()))
        g, start, end = _spans(piece, at, several if keep == "none" else earlier, min_length)
        return pa.Table.from_arrays([pa.array(did[g]), pa.array(rid[g]), pa.array(lo[g] + start),
                                     pa.array(lo[g] + end)], schema=schema)
    return scan


CUT = "bucket long, key long, did long, rid long, lo long, bytes binary"
WINDOW = "key long, window long, did long, rid long, lo long"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted fragments of each text."""
    names = [x.split()[0] for x in CUT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    for batch in batches:
        rows, size = [], 0
        for did, rid, text, wants in zip(*(batch.column(c).to_pylist() for c in ("_did", "_rid", "raw", "wants"))):
            raw = (text or "").encode()
            for want in wants:
                if not want["hot"]:
                    rows.append((want["bucket"], want["key"], did, rid, want["lo"], raw[want["lo"]:want["hi"]]))
                    size += want["hi"] - want["lo"] + 64
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)


def _window_hashes(min_length: int):
    """Hashes of the windows of wanted fragments, for keys that are too frequent for a bucket."""
    names = [x.split()[0] for x in WINDOW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for did, rid, text, wants in zip(*(batch.column(c).to_pylist() for c in ("_did", "_rid", "raw", "wants"))):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                for want in (w for w in wants if w["hot"]):
                    for a in range(want["lo"], want["hi"] - min_length + 1, 100_000):
                        b = min(a + 100_000, want["hi"] - min_length + 1)
                        at = np.arange(b - a)
                        h = run_hashes(byte_table(23)[raw[a:b + min_length - 1]], at, at + min_length)
                        held.append([np.full(b - a, want["key"], _S64), h.view(_S64), np.full(b - a, did, _S64),
                                     np.full(b - a, rid, _S64), a + at])
                        size += b - a
                        if size > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                            held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
    return run


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with columns c0, c1, ... (so that no name can clash), and `did`, `rid`: a row's place in the
    order and a hash that names its text. `raw` is the text."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    kept = [F.col(f"`{c}`").alias(f"c{i}" if c != "text" else "raw") for i, c in enumerate(docs.columns)]
    return docs.select(*kept, did.alias("_did"), F.xxhash64(did, F.coalesce(F.col("text"), F.lit(""))).alias("_rid"))


def repeated_spans(docs: DataFrame, min_length: int = MIN_LENGTH, keep: str = "none",
                   bucket_bytes: int = BUCKET_BYTES, group: str | None = None, gram: int = GRAM) -> DataFrame:
    """(_did, _rid, spans) of the rows of `keyed` documents with something to remove; spans may overlap.

    With `group` (a column of hashes), strings count as repeated if they occur in
    different documents of one group (`keep="none"` only).
    """
    across = group is not None
    own = F.col(group) if across else F.lit(0).cast("long")
    found = docs.select("_did", "_rid", "raw", own.alias("_g")).mapInArrow(_fragment_rows(min_length, gram), FRAGMENT)
    # 2. keys that occur more than once
    often = (found.groupBy("key").agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n"))
             .filter(F.col("n") > 1).select("key"))
    found = common.stored(found.join(often, "key"), "fragments")
    # 3. one row for equal fragments
    length = F.col("first.hi") - F.col("first.lo")
    equal = found.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("alone"), F.max("did").alias("last"),
                                             F.min(F.struct("did", "rid", "lo", "hi")).alias("first"))
    by_key = equal.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(length).alias("bytes"))
    kinds = common.stored(
        equal.join(by_key, "key").select("key", "same", "n", "first", "last", (F.col("bytes") > 2 * bucket_bytes).alias("hot"),
                                         ((F.col("kinds") > 1) | ~F.col("alone")).alias("open")), "kinds")
    total = kinds.filter("open and not hot").agg(F.sum(length)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    at, first = F.struct("did", "rid", "lo"), F.struct("first.did", "first.rid", "first.lo")
    several = "n > 1 and first.did != last" if across else "n > 1"
    whole = found.join(kinds.filter(several).select("key", "same", "first"), ["key", "same"])
    if keep == "first":
        whole = whole.filter(at != first)
    ask = kinds.filter("open").select(
        F.col("first.did").alias("_did"), F.col("first.rid").alias("_rid"),
        F.struct(F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), "key", "hot",
                 F.pmod(F.col("key"), F.lit(buckets)).alias("bucket")).alias("want"))
    # all columns go along, so that the last join can use the same shuffle of the texts
    ask = ask.groupBy("_did", "_rid").agg(F.collect_list("want").alias("wants"))
    wanted = docs.join(ask, ["_did", "_rid"])
    # 4. suffix arrays
    inside = (wanted.mapInArrow(_cut_out, CUT).groupBy("bucket")
              .applyInArrow(_bucket_spans(min_length, keep, across), "did long, rid long, lo long, hi long"))
    out = whole.select("did", "rid", "lo", "hi").union(inside)
    # 5. windows of keys that are too frequent for a bucket
    if kinds.filter("hot and open").limit(1).count():
        windows = common.stored(wanted.filter(F.exists("wants", lambda x: x["hot"]))
                                .mapInArrow(_window_hashes(min_length), WINDOW), "windows")
        twice = (windows.groupBy("key", "window")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max("did").alias("last")).filter(several))
        hot = windows.join(twice, ["key", "window"])
        if keep == "first":
            hot = hot.filter(at != F.col("first"))
        out = out.union(hot.select("did", "rid", "lo", (F.col("lo") + min_length).alias("hi")))
    return out.groupBy(F.col("did").alias("_did"), F.col("rid").alias("_rid")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged_spans(spans: pa.Scalar | None) -> list[tuple[int, int]]:
    """Maximal runs of a row's spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in runs:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs narrowed so that they cut no UTF-8 character."""
    out = []
    for lo, hi in runs:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def with_spans(docs: DataFrame, min_length: int, keep: str, bucket_bytes: int) -> DataFrame:
    rows = keyed(docs)
    return rows.join(repeated_spans(rows, min_length, keep, bucket_bytes), ["_did", "_rid"], "left")


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, keep: str = "first",
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` with the repeated passages taken out of `text` (in whole characters); same rows and columns."""
    names = list(docs.columns)
    at = names.index("text")
    rows = with_spans(docs, min_length, keep, bucket_bytes).select(
        *(f"c{i}" if c != "text" else "raw" for i, c in enumerate(names)), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for i, s in enumerate(spans):
                text = texts[i].as_py()
                if s and text:
                    raw = text.encode()
                    text = kept_bytes(raw, whole_characters(raw, merged_spans(s))).decode()
                out.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)
    return rows.mapInArrow(run, T.StructType(docs.schema.fields))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        size, removed, count, digest = [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            raw, runs = buf[offsets[i]:offsets[i + 1]].tobytes(), merged_spans(spans)
            size.append(len(raw))
            removed.append(sum(b - a for a, b in runs))
            count.append(len(runs))
            digest.append(hashlib.sha256(kept_bytes(raw, runs)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
             pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(docs, MIN_LENGTH, "none", BUCKET_BYTES).select("c0", "raw", "spans").mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
