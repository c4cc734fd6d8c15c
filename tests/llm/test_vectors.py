import numpy as np
import pyarrow.parquet as pq
import pytest

from matchday.llm import vectors


def brute(ids, v, query_ids, k):
    out = {}
    for q in query_ids:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        rows = [(d[i], ids[i]) for i in range(len(ids)) if ids[i] != q]
        out[q] = sorted(rows)[:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)
    got = by_query(vectors.op7_nearest(spark, f"/root/testdata/{sf}").collect())
    want = brute(ids, v, [i for i in ids if i % 100 == 0], 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.93
    for rows in got.values():
        assert rows == sorted(rows) and len(rows) == 10


def test_all_lists_and_hot_vector_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(500, 8))])
    ids = rng.permutation(800)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = by_query(vectors.search(vectors.valid_vectors(df), lambda i: i % 10 == 0, lists=6, probes=6, block_rows=50,
                                  block_queries=30).collect())
    want = brute(ids, v, [i for i in ids if i % 10 == 0], 10)
    assert recall(got, want) > 0.98
    hot = [q for q in want if want[q][-1][0] == 0]
    assert hot and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in hot)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 1.0], 2), (200, None, 3), (300, [0.0, 0.0], 4), (400, [1.0, float("nan")], 5),
            (500, [float("inf"), 1.0], 6), (600, [None, 1.0], 7), (700, [1.0, 2.0, 3.0], 8), (100, [1.0, 1.0], 9),
            (None, [1.0, 5.0], 10), (3, [2.0, 0.0], 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = by_query(vectors.search(vectors.valid_vectors(df), lambda i: i % 100 == 0).collect())
    assert got == {0: [(1.0, 3), (1.0, 100)], 100: [(1.0, 0), (np.sqrt(2), 3)]}
    assert vectors.search(vectors.valid_vectors(df.limit(0)), lambda i: i % 100 == 0).count() == 0
