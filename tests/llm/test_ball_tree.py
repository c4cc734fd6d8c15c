import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchday.llm import ball_tree

SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, x, query_ids, k):
    out, ints = {}, [[int(a) for a in row] for row in x]
    place = {i: n for n, i in enumerate(ids)}
    for q in query_ids:
        scores = [(-sum(a * b for a, b in zip(ints[place[q]], row)), i) for i, row in zip(ids, ints) if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_equals_brute_force(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids = t["vec_id"].to_pylist()
    x = np.floor(256 * np.stack(t["embedding"].to_numpy()).astype(float)).astype(int)
    got = by_query(ball_tree.op11_ball_tree(spark, f"/root/testdata/{sf}").collect())
    assert got == brute(ids, x, [i for i in ids if i % 50 == 0], 5)


def test_many_shards_hot_vector_and_query_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (900, 6))
    x[300:600] = x[0]                       # a third of all rows are one vector
    ids = rng.permutation(5000)[:900].tolist()
    df = spark.createDataFrame([(i, [int(c) for c in row]) for i, row in zip(ids, x)], "vec_id long, x array<long>")
    got = by_query(ball_tree.search(df, lambda c: c % 3 == 0, k=4, shard_rows=40, block_queries=50).collect())
    assert got == brute(ids, x, [i for i in ids if i % 3 == 0], 4)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 5)) * 400
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(2400, 5)) * 10).astype(np.int64)
    ids = rng.permutation(2400)
    tree = ball_tree.build(x.astype(float), ids)
    best = ball_tree.Best(40, 5)
    computed = ball_tree.search_tree(tree, x, ids, x[::60], ids[::60], best)
    assert computed < 40 * 2400 / 3
    want = brute(ids.tolist(), x, ids[::60].tolist(), 5)
    assert {int(q): list(zip(i.tolist(), s.tolist())) for q, i, s in zip(ids[::60], best.id, best.score)} == want
    for n in range(len(tree.start)):        # no vector of a node scores above its bound
        rows = tree.order[tree.start[n]:tree.end[n]]
        q = x[7].astype(float)
        bound = ball_tree.upper_bounds(q[None], np.sqrt((q ** 2).sum())[None], tree.centre[n][None], tree.radius[n][None])
        assert (x[rows] @ x[7]).max() <= bound[0]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (7, [1.0]), (8, []), (9, [1e300, 1.0]), (10, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit(1)).withColumn("shard", F.lit("s"))
    got = by_query(ball_tree.search(ball_tree.integer_vectors(df), lambda c: c == 0).collect())
    big = (1 << 63) - 1
    assert got == {0: [(9, big), (6, 128 * 256 + 9 * 2 * 65536), (5, 0), (10, -big - 1)]}
    assert ball_tree.search(ball_tree.integer_vectors(df.limit(0)), lambda c: c == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert ball_tree.search(ball_tree.integer_vectors(one), lambda c: c == 0).collect() == []
