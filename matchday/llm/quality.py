"""Quality scores (operator 8): a factorisation machine over hashed words and structure.

The score of a text is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so that all pairwise interactions cost time linear in the number of features.
Features: hashed lower-cased words (logarithm of their count, the block scaled
to length one), statistics of the text's structure, and its length as metadata.
`doc_id`, `lang`, `source` and the labels are never features.

The model is fitted on at most `max_rows` labelled texts (those whose id hashes
lowest), gathered as features; scoring reads every text whole, where it lies.

Defined results: null and empty texts are scored like other texts (all counts
are zero); a null `doc_id` is scored and counts as not held out; of several
label rows for one id the mean decides (one half counts as 1); null labels are
left out; with no usable label the score is 1 everywhere, with one class only
it is near that class; an empty table gives no rows; an input column that has
the score's name is replaced, other extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.tables import read_table
from . import common
from .common import U64, byte_table, run_hashes, text_buffer

BITS = 14             # hashed words: 2**BITS buckets
FACTORS = 4
MAX_ROWS = 20_000     # labelled rows a model is fitted on, at most
STEPS = 1000          # mini-batches of the fit
THRESHOLD = 0.7
CHUNK = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# byte classes whose shares are features: each a set of byte values
_CLASSES = [range(97, 123), range(65, 91), range(48, 58), range(128, 256), [32], [10, 13], [9], [33], [63], [46, 44],
            [58, 59], [124], [35, 36, 37, 38, 42], [60, 62, 123, 125, 91, 93], [34, 39], [45, 95], [47, 92, 64]]
STATS = ([f"share_{i}" for i in range(len(_CLASSES))]
         + ["log_bytes", "log_words", "word_length", "distinct_words", "same_as_last_word", "log_lines",
            "distinct_lines", "words_per_line", "top_byte", "no_words"])


@dataclass
class Features:
    """Sparse words (row, bucket, value) in row order, and a dense row of STATS per text."""
    rows: np.ndarray
    buckets: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside`, cut where a text begins."""
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | first[1:])) + 1


def _distinct_share(rows: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row over its number of hashes (1 for none)."""
    n = len(counts)
    key = np.unique((rows.astype(U64) << U64(40)) | (h >> U64(24)))
    got = np.bincount((key >> U64(40)).astype(np.int64), minlength=n)
    return np.where(counts > 0, got / np.maximum(counts, 1), 1.0)


def featurize(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Features:
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    hist = np.bincount(owner * 256 + buf, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1).astype(np.float64)
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    symbols = byte_table(7)[_LOWER][buf]

    starts, ends = _runs(_WORD[buf], first)
    h = run_hashes(symbols, starts, ends)
    rows = owner[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(rows, minlength=n)
    length = np.bincount(rows, weights=ends - starts, minlength=n)
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(rows[1:], weights=(h[1:] == h[:-1]) & (rows[1:] == rows[:-1]), minlength=n)
    lines_at, lines_to = _runs((buf != 10) & (buf != 13), first)
    line_rows = owner[lines_at] if len(lines_at) else np.zeros(0, np.int64)
    lines = np.bincount(line_rows, minlength=n)
    line_h = run_hashes(symbols, lines_at, lines_to)

    stats = np.column_stack(
        [hist[:, list(c)].sum(1) / total for c in _CLASSES]
        + [np.log1p(size), np.log1p(words), length / np.maximum(words, 1), _distinct_share(rows, h, words),
           same / np.maximum(words, 1), np.log1p(lines), _distinct_share(line_rows, line_h, lines),
           np.log1p(words / np.maximum(lines, 1)), hist.max(1) / total, (words == 0).astype(float)])
    key, counts = np.unique((rows.astype(np.int64) << bits) | (h >> U64(64 - bits)).astype(np.int64),
                            return_counts=True)
    r = key >> bits
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(r, weights=value * value, minlength=n))
    return Features(r, key & ((1 << bits) - 1), value / np.maximum(norm[r], 1e-12) if len(r) else value, stats)


@dataclass
class Model:
    """Weights `w` and factors `v`: one row per bucket, then one per statistic."""
    bits: int
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATS)))

    def dense(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics, kept within a few deviations."""
        return np.clip((stats - self.mean) / self.scale, -5, 5) / 4

    def margins(self, f: Features) -> np.ndarray:
        x, k = self.dense(f.stats), 1 << self.bits
        n = len(x)
        linear = x @ self.w[k:] + np.bincount(f.rows, weights=self.w[f.buckets] * f.values, minlength=n)
        pairs = np.zeros(n)
        for j in range(self.v.shape[1]):
            word = self.v[f.buckets, j] * f.values
            s = np.bincount(f.rows, weights=word, minlength=n) + x @ self.v[k:, j]
            q = np.bincount(f.rows, weights=word * word, minlength=n) + (x * x) @ (self.v[k:, j] ** 2)
            pairs += s * s - q
        return self.w0 + linear + pairs / 2

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(f), -30, 30)))


def fit(f: Features, labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, steps: int = STEPS,
        rate: float = 0.3, decay: float = 1e-5, batch: int = 256, seed: int = 0) -> Model:
    """Logistic loss by Adagrad over mini-batches; the order of rows is drawn from `seed`."""
    at = np.searchsorted(f.rows, np.arange(len(labels) + 1))
    return _fit(at[:-1], np.diff(at), f.buckets, f.values, f.stats, labels, bits, factors, steps, rate, decay, batch, seed)


def _fit(starts: np.ndarray, counts: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray, labels: np.ndarray, bits: int,
         factors: int, steps: int, rate: float = 0.3, decay: float = 1e-5, batch: int = 256, seed: int = 0) -> Model:
    """`fit` on rows whose words lie at `starts`, in any order; only a mini-batch of them is copied."""
    n, k, m = len(labels), 1 << bits, len(STATS)
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (n + 1)
    start = float(np.log(prior / (1 - prior))) if prior < 1 else 30.0
    model = Model(bits, start, np.zeros(k + m), rng.normal(0, 0.02, (k + m, factors)))
    if n == 0 or labels.min() == labels.max():
        model.v[:] = 0
        return model
    model.mean, model.scale = stats.mean(0), stats.std(0) + 1e-6
    x = model.dense(stats)
    gw, gv, g0 = np.full(k + m, 1e-2), np.full((k + m, factors), 1e-2), 1e-2
    for _ in range(-(-steps // -(-n // batch))):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo:lo + batch]
            b = len(rows)
            length = counts[rows]
            pos = common.ragged(starts[rows], length)
            local = np.repeat(np.arange(b), length)
            bucket, value, dense = buckets[pos].astype(np.int64), values[pos].astype(np.float64), x[rows]
            vw, vd = model.v[bucket] * value[:, None], model.v[k:]
            s = np.stack([np.bincount(local, weights=vw[:, j], minlength=b) for j in range(factors)], 1) + dense @ vd
            q = np.stack([np.bincount(local, weights=vw[:, j] ** 2, minlength=b) for j in range(factors)], 1) \
                + (dense ** 2) @ (vd ** 2)
            margin = (model.w0 + dense @ model.w[k:] + np.bincount(local, weights=model.w[bucket] * value, minlength=b)
                      + (s * s - q).sum(1) / 2)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / b
            e = err[local] * value
            dw = np.concatenate([np.bincount(bucket, weights=e, minlength=k), dense.T @ err]) + decay * model.w
            dv = np.empty_like(model.v)
            for j in range(factors):
                dv[:k, j] = np.bincount(bucket, weights=e * (s[local, j] - vw[:, j]), minlength=k)
            dv[k:] = dense.T @ (err[:, None] * s) - ((dense ** 2).T @ err)[:, None] * vd
            dv += decay * model.v
            gw += dw * dw
            gv += dv * dv
            g0 += err.sum() ** 2
            model.w -= rate * dw / np.sqrt(gw)
            model.v -= rate * dv / np.sqrt(gv)
            model.w0 -= rate * err.sum() / np.sqrt(g0)
    return model


FEATURE_SCHEMA = "label double, buckets array<int>, weights array<float>, stats array<double>"


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for a, b in common.row_chunks(offsets, CHUNK):
                f = featurize(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bits)
                at = pa.array(np.searchsorted(f.rows, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(f.buckets, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(f.values, pa.float32())),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(STATS), pa.int32()),
                                              pa.array(f.stats.ravel()))],
                    ["label", "buckets", "weights", "stats"])
    return run


def held_out(doc_id) -> F.Column:
    """Rows kept from fitting: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most `max_rows` labelled ids outside the held-out part, those with the lowest hashes."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))))
    rows = rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
          bits: int = BITS, factors: int = FACTORS, steps: int = STEPS) -> Model:
    """Fit on a bounded sample of labelled texts, of which only features reach the driver."""
    sample = labelled_sample(labels, label, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")       # at most max_rows ids
    # an id that occurs often counts once
    rows = rows.dropDuplicates(["doc_id"]).select("label", "text")
    # the driver has these columns once, in the types they come in: ids and weights take 8 bytes together
    got = rows.mapInArrow(_feature_rows(bits), FEATURE_SCHEMA).toArrow()
    y, stats = got.column("label").to_numpy(), np.zeros((0, len(STATS)))
    if len(y):
        stats = np.concatenate([c.flatten().to_numpy() for c in got.column("stats").chunks]).reshape(len(y), len(STATS))
    # the order that rows arrive in must not matter
    order = np.lexsort((stats[:, 0], stats[:, len(_CLASSES)], y)) if len(y) else np.zeros(0, np.int64)
    at, buckets, values = [np.zeros(1, np.int64)], [], []
    for c in got.column("buckets").chunks:
        at.append(at[-1][-1] + np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)))
        buckets.append(c.flatten().to_numpy())
    for c in got.column("weights").chunks:
        values.append(c.flatten().to_numpy())
    at = np.concatenate(at)
    buckets = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
    values = np.concatenate(values) if values else np.zeros(0, np.float32)
    del got
    return _fit(at[:-1][order], np.diff(at)[order], buckets, values, stats[order], y[order], bits, factors, steps)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """`docs` with the model's score of its `text`; all rows and other columns are kept."""
    model = Model(model.bits, model.w0, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.scale)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # 2**bits * (factors + 1) numbers
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    src = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = [c.lower() for c in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offsets = text_buffer(batch.column(at))
            for a, b in common.row_chunks(offsets, CHUNK):
                f = featurize(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], m.bits)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(f).astype(np.float64))],
                                                 [*part.schema.names, column])
    schema = T.StructType([*src.schema.fields, T.StructField(column, T.DoubleType())])
    return src.mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
