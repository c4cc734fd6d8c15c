import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchday.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """vec_id -> (deviation, whitened); and (n, explained), with exact integer moments."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    centred = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], centred @ u / np.sqrt(e), e / np.trace(v)


def check(got, rows, tolerance=1e-9):
    n, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == n * k
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == n * k
    for c in range(k):
        mine = np.array([table[i, c + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, c])
        np.testing.assert_allclose(mine, sign * white[:, c], atol=1e-7)
    for (i, _), dev in zip(rows, deviation):
        assert table[i, 1].deviation == dev and table[i, 1].n == n
    np.testing.assert_allclose([table[rows[0][0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < tolerance


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_equals_brute_force(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    check(whitening.op13_whitening(spark, f"/root/testdata/{sf}").collect(), rows)


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << np.array([1, 5, 40, 9]), (333, 4))
    x[:, 3] = 77                                             # a dimension without variance
    low, bits = x.min(0), np.array([int(b).bit_length() for b in x.max(0) - x.min(0)])
    cross, sums = whitening.weighted(whitening.shared_bits(whitening.bit_planes(x - low, bits)), bits)
    y = (x - low).astype(object)
    assert (cross == y.T.dot(y)).all() and (sums == y.sum(0)).all()


def test_small_wide_and_far_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b) * 1e4, float(c) * 1e-1]) for i, (a, b, c) in enumerate(rng.normal(size=(50, 3)))]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), rows, 1e-6)   # variances 1e11 apart


def test_odd_rows(spark):
    good = [(None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [3.0, 5.0])]
    odd = [(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0]), (6, [])]
    df = spark.createDataFrame(good + odd, SCHEMA).withColumn("x", F.lit(1)).withColumn("component", F.lit("c"))
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in good for _ in "ab")
    assert {r.n for r in got} == {4}
    assert whitening.whiten(df.limit(0)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], SCHEMA)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0])], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and all(r.identity_error < 1e-9 for r in line)
    far = whitening.whiten(spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [1e12])], SCHEMA)).collect()
    assert {r.vec_id for r in far} == {1, 2} and {r.deviation for r in far} == {None}
