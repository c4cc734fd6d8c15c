"""Sequence packing (operator 10): hierarchical packing into several context sizes.

Every document is routed by its length to a tier of 2048, 1024, 512 or 256
tokens. A document's full 2048-token stretches are windows of their own; the
rest joins its tier. Tiers are packed from the longest: a window opens with the
longest piece of its tier, its gap takes the longest pieces of the shorter
tiers that still fit, and the last gap takes the head of one more piece, whose
tail goes back to the pool. So each window is full. What a partition has left
at its end (under one window) is laid out in windows of decreasing powers of
two. No window needs padding: each is 2048 long or a shorter power of two.

Windows of one size are dealt to step groups of equal token counts, so that all
steps of training cost the same.

Packing runs inside each input partition, in blocks of bounded size; nothing is
shuffled. Ids of sequences carry the partition's number in the upper bits.

Defined results: a null or empty text has the end id alone; repeated rows are
packed as often as they occur; a null `doc_id` is packed like another; an empty
table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .tokens import encoder, with_end

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 32 * WINDOW     # tokens of a step group
BLOCK_TOKENS = 4_000_000      # a partition is packed in blocks of about so many tokens
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, tier int, step_group long")


class Pool:
    """Pieces (document, start) by length; finds the longest that fits."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append((doc, start))
        self.tokens += length

    def take(self, length: int) -> tuple[int, int, int]:
        rows = self.by_length[length]
        doc, start = rows.pop()
        if not rows:
            del self.by_length[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.tokens -= length
        return doc, start, length

    def longest(self, at_most: int) -> tuple[int, int, int] | None:
        i = bisect_right(self.lengths, at_most)
        return self.take(self.lengths[i - 1]) if i else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self.take(self.lengths[0]) if self.lengths else None


def fill(pool: Pool, size: int) -> list[tuple[int, int, int]]:
    """Pieces that fill a window of `size` tokens; the pool holds enough of them."""
    row, gap = [], size
    while gap:
        piece = pool.longest(gap)
        if piece is None:
            doc, start, length = pool.shortest()
            pool.add(doc, start + gap, length - gap)
            piece = doc, start, gap
        row.append(piece)
        gap -= piece[2]
    return row


def pack_block(pool: Pool, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list]]:
    """(window size, pieces) of what the pool holds; without `last`, under a window stays."""
    for k, size in enumerate(tiers):
        least = tiers[k + 1] if k + 1 < len(tiers) else 0
        # windows that a piece of this tier opens, as long as a full one can be made
        while pool.tokens >= size and pool.lengths and pool.lengths[-1] > least:
            yield size, fill(pool, size)
    if last:
        while pool.tokens:
            size = 1 << (min(pool.tokens, tiers[0]).bit_length() - 1)
            yield size, fill(pool, size)


def _pack_partition(name: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, window = encoder(name), tiers[0]
        high = TaskContext.get().partitionId() << 32
        pool, held = Pool(), {}          # held: document -> (doc_id, tokens, ids kept from, ids)
        state = {"doc": 0, "seq": 0, "fresh": 0}
        steps: dict[int, tuple[int, int]] = {}

        def emit(rows: list, size: int, out: list) -> None:
            used, group = steps.get(size, (step_tokens, 0))
            if used + size > step_tokens:
                used, group = 0, high | state["seq"]   # the number of its first sequence
            steps[size] = used + size, group
            offset = 0
            for doc, start, length in rows:
                doc_id, total, base, ids = held[doc]
                crc = zlib.crc32(ids[start - base:start - base + length].tobytes())
                out.append((doc_id, start, length, crc, total, high | state["seq"], offset, size, size, group))
                offset += length
            state["seq"] += 1

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            out: list = []
            for size, rows in pack_block(pool, tiers, last):
                emit(rows, size, out)
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            kept = {}
            for length, rows in pool.by_length.items():
                for doc, start in rows:
                    kept.setdefault(doc, []).append((start, length))
            for doc in [d for d in held if d not in kept]:
                del held[doc]
            for doc, spans in kept.items():   # of a document that waits, only the ids that wait
                doc_id, total, base, ids = held[doc]
                lo, hi = min(s for s, _ in spans), max(s + n for s, n in spans)
                held[doc] = doc_id, total, lo, ids[lo - base:hi - base].copy()
            state["fresh"] = 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            buf, offsets = common.text_buffer(batch.column(1))
            for a, b in common.row_chunks(offsets, 4 << 20):
                own = offsets[a:b + 1]
                ids, at = with_end(*enc.encode(buf[own[0]:own[-1]], own - own[0]), end_id)
                out: list = []
                for i in range(b - a):
                    doc, state["doc"] = state["doc"], state["doc"] + 1
                    mine = ids[at[i]:at[i + 1]].astype("<u4", copy=False)
                    held[doc] = doc_ids[a + i], len(mine), 0, mine
                    full = len(mine) // window * window
                    for start in range(0, full, window):
                        emit([(doc, start, window)], window, out)
                    if len(mine) > full:
                        pool.add(doc, full, len(mine) - full)
                if out:
                    yield batch_of(out)
                state["fresh"] += len(ids)
                if state["fresh"] >= block_tokens:
                    yield from flush(False)
        yield from flush(True)
    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of `docs(doc_id, text)`: where it lies in its document and in its sequence.

    `tiers` are decreasing powers of two. `sequence_length` is the window's size
    (no padding), `step_group` gathers windows of one size worth `step_tokens`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_pack_partition(tokenizer, end_id, tuple(tiers), step_tokens, block_tokens), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
