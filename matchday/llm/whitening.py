"""Whitening of embeddings (operator 13): exact covariance by a bit-sliced scatter, then `eigh`.

Entries become integers, x = floor(scale * c) + offset. Each dimension is shifted by its
least value, so that few bits are left, and every task packs each bit of each
dimension over its rows into 64-bit words (a bit plane). The cross-product of two
dimensions is the sum over pairs of their planes of 2**(a + b) times the number of
bits set in both (AND, population count). These sums are whole numbers, added up by
Spark as decimals; the driver gets one number for each pair of dimensions, centres
them as integers (n * P - s * s') and only then goes over to doubles.

Defined results: a vector that is null, holds null or non-finite entries (or entries
beyond `LIMIT`, whose integers would not fit) or has another dimension than most (of
equally frequent ones the smaller) takes no part; every other row counts and comes
out, also with a null or repeated id; a component without variance (e within 1e-12 of
the trace) has a null `whitened` and stays out of `identity_error`; a deviation beyond
a long is null; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import read_table
from . import common

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 34)
COMPONENTS = 32
PLANE_ROWS = 1 << 15      # rows whose planes are crossed at a time
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """The fitted transform; its size depends on the dimension alone."""
    n: int
    sums: list[int]               # S of each dimension, exact
    covariance: np.ndarray        # V
    values: np.ndarray            # eigenvalues, falling
    axes: np.ndarray              # unit eigenvectors, one a column

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > NO_VARIANCE * max(np.trace(self.covariance), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        centred = centred_integers(x, self.n, self.sums).astype(float) / self.n
        live = self.live
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, live] = centred @ self.axes[:, live] / np.sqrt(self.values[live])
        return out


def fixed_point(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id",
                scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) with integer entries, of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(v, lambda c: F.floor(c * scale) + offset).alias("x"))
    return rows


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred_integers(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where it fits, else Python integers."""
    top = max((abs(s) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    if top < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def bit_planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """One row of 64-bit words for each bit of each dimension, dimensions in order, low bits first."""
    rows = -(-len(shifted) // 64) * 64
    padded = np.zeros((rows, shifted.shape[1]), np.uint64)
    padded[:len(shifted)] = shifted.astype(np.uint64)
    planes = [[] for _ in bits]
    for a in range(int(bits.max(initial=0))):
        has = np.flatnonzero(bits > a)
        bit = ((padded[:, has] >> np.uint64(a)) & np.uint64(1)).astype(np.uint8)
        words = np.ascontiguousarray(np.packbits(bit, axis=0, bitorder="little").T).view(np.uint64)
        for j, w in zip(has.tolist(), words):
            planes[j].append(w)
    flat = [w for own in planes for w in own]
    return np.stack(flat) if flat else np.zeros((0, rows // 64), np.uint64)


def shared_bits(planes: np.ndarray) -> np.ndarray:
    """Rows that have both bits, for every pair of planes."""
    out = np.zeros((len(planes),) * 2, np.int64)
    for p in range(len(planes)):
        out[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(1, dtype=np.int64)
    return np.triu(out) + np.triu(out, 1).T


def weighted(counts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-products, sums) of the shifted dimensions from the counts of their planes, as Python integers."""
    d, of = len(bits), np.repeat(np.arange(len(bits)), bits)
    power = np.concatenate([np.arange(b) for b in bits]).astype(int) if len(of) else np.zeros(0, int)
    weights = np.zeros((d, len(of)), object)
    weights[of, np.arange(len(of))] = [1 << int(a) for a in power]
    if 2 * int(bits.max(initial=0)) + int(counts.max(initial=0)).bit_length() < 60:
        small = weights.astype(np.int64)
        return (small @ counts @ small.T).astype(object), (small @ np.diag(counts)).astype(object)
    return weights.dot(counts.astype(object)).dot(weights.T), weights.dot(np.diag(counts).astype(object))


def _scatter(low: np.ndarray, bits: np.ndarray):
    """One task's (i, j, total): cross-products for j >= 0, sums for j = -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((int(bits.sum()),) * 2, np.int64)
        seen = False
        for batch in batches:
            x = matrix(batch.column(0)) - low if len(batch) else np.zeros((0, len(low)), np.int64)
            for a in range(0, len(x), PLANE_ROWS):
                seen = True
                counts += shared_bits(bit_planes(x[a:a + PLANE_ROWS], bits))
        if seen:
            cross, sums = weighted(counts, bits)
            i, j = np.tril_indices(len(low))
            total = [Decimal(int(t)) for t in cross[i, j]] + [Decimal(int(t)) for t in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, np.arange(len(low))]), pa.int32()),
                 pa.array(np.concatenate([j, np.full(len(low), -1)]), pa.int32()), pa.array(total, pa.decimal128(38, 0))],
                ["i", "j", "total"])
    return run


def same_dimension(rows: DataFrame) -> DataFrame:
    """`rows` of the most frequent dimension, none if there are no rows."""
    shape = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.lit(False)) if shape is None else rows.filter(F.size("x") == shape["d"])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The transform of all `rows(x)`, which have one dimension."""
    ranges = sorted(rows.select(F.posexplode("x").alias("i", "x")).groupBy("i")
                    .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).collect())
    if not ranges:                                           # one row per dimension otherwise
        return None
    n, low = ranges[0]["n"], np.array([r["low"] for r in ranges], np.int64)
    bits = np.array([(r["high"] - r["low"]).bit_length() for r in ranges])
    found = (rows.select("x").mapInArrow(_scatter(low, bits), "i int, j int, total decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("total").alias("total")).collect())     # dimension ** 2 / 2 rows
    total = {(r["i"], r["j"]): int(r["total"]) for r in found}
    d = len(low)
    s = [total[i, -1] for i in range(d)]
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(i + 1):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - s[i] * s[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, [a + n * int(b) for a, b in zip(s, low)], covariance, values, axes)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened rows - identity|, measured over all rows."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return None

    def moments(batches):
        size = len(live) + 1
        out = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                w = model.project(matrix(batch.column(0)))[:, live]
                w = np.concatenate([w, np.ones((len(w), 1))], 1)
                out += w.T @ w
        i, j = np.indices(out.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out.reshape(-1))],
                                         ["i", "j", "s"])
    sums = np.zeros((len(live) + 1,) * 2)
    for r in rows.select("x").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = r["s"]
    mean = sums[:-1, -1] / model.n
    return float(np.abs(sums[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exact; null where a long can't hold it."""
    c = centred_integers(x, model.n, model.sums)
    top = int(np.abs(c).max(initial=0))
    if c.dtype != object and c.shape[1] * top * top < 1 << 63:
        return (c * c).sum(1).tolist()
    return [t if t < 1 << 63 else None for t in (sum(int(a) ** 2 for a in row) for row in c)]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component."""
    rows = same_dimension(common.stored(fixed_point(vectors, column, id_column), "whitening"))
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    error = identity_error(rows, model)
    trace, names = float(np.trace(model.covariance)), [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        k = len(model.values)
        explained = model.values / trace if trace > 0 else np.full(k, np.nan)
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            x = matrix(batch.column(1))
            at = pa.array(np.repeat(np.arange(m), k))
            w, share = model.project(x).reshape(-1), np.tile(explained, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, model.n)), pa.array(deviations(x, model), pa.int64()).take(at),
                 pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)),
                 pa.array([error] * (m * k), pa.float64())], names)
    return rows.select("vec_id", "x").mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
