"""Exact top-k by inner product (operator 11): a ball tree per shard, searched by branch and bound.

Components become integers (floor(scale * x)), so scores are whole numbers and
ties are real ties. Vectors are dealt to shards by place: the leaves of a ball
tree over a bounded sample are the cells, every vector goes to the cell of the
nearest centre, and a cell that is too large is cut by the hash of the id.

Each shard builds its ball tree (split at the median between two far points).
No vector of a ball with centre c and radius r scores above q·c + |q|·r.
1. Every query searches the shard it lies in, which gives a first k-th score.
2. It goes on to the shards whose own ball may hold better ones, and takes its
   k-th (score, id) along; nodes are descended while their bound reaches it, and
   leaves are read from the highest bound down, until the next can't help.
3. The k best of all shards are the result. Nothing is approximate.

Defined results: a vector that is null, empty, or holds null or non-finite
components, or has another dimension than most (of equally frequent ones the
smaller), takes no part, nor does a null id; a zero vector does; of several rows
with one id the smallest vector counts, once; ties go to the smaller id; all
candidates are returned if there are fewer than k; an integer beyond a long is
cut to it, and so is a score; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.tables import read_table
from . import common
from .whitening import matrix, same_dimension

K = 5
SCALE = 256
SAMPLE = 20_000          # vectors that cells are cut from, at most
SHARD_ROWS = 4096        # of a shard, about
MAX_CELLS = 2048         # beyond MAX_CELLS * SHARD_ROWS vectors shards grow instead
LEAF = 64                # vectors of a leaf
BLOCK_QUERIES = 16_384   # queries that meet a shard in one task, about
_FEW = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) with integer components, of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    ok = F.col(id_column).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


@dataclass
class BallTree:
    """Nodes in preorder: rows [start, end) of the permuted points, centre, radius, least id, children (-1: leaf)."""
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray
    children: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
    """The ball tree of `points` (rows)."""
    order = np.arange(len(points))
    nodes, todo = [], [(0, len(points), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = points[order[a:b]]
        centre = own.mean(0)
        far = ((own - centre) ** 2).sum(1)
        at = len(nodes)
        nodes.append([a, b, centre, float(np.sqrt(far.max(initial=0.0))), int(ids[order[a:b]].min(initial=_LAST)), [-1, -1]])
        if parent >= 0:
            nodes[parent][5][side] = at
        if b - a > leaf and nodes[at][3] > 0:
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            place = np.argsort(own @ (other - one), kind="stable")
            order[a:b] = order[a:b][place]
            mid = (a + b) // 2
            todo += [(mid, b, at, 1), (a, mid, at, 0)]
    start, end, centre, radius, least, children = zip(*nodes)
    return BallTree(order, np.array(start), np.array(end), np.stack(centre), np.array(radius), np.array(least), np.array(children))


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No whole-number score of a ball is above this (rounding errors of the doubles included)."""
    reach = norms * (np.sqrt((centre ** 2).sum(-1)) + radius)
    return np.floor((queries * centre).sum(-1) + norms * radius + reach * 1e-12 + 1e-9)


def exact_products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by doubles where these are exact, else by Python integers cut to a long."""
    big = int(np.abs(queries.astype(float)).max(initial=0)) * int(np.abs(x.astype(float)).max(initial=0)) * max(1, x.shape[1])
    if big < 1 << 53:
        return (queries.astype(float) @ x.astype(float).T).astype(np.int64)
    out = queries.astype(object).dot(x.astype(object).T)
    return np.clip(out, _FEW, _LAST).astype(np.int64) if out.size else np.zeros(out.shape, np.int64)


class Best:
    """The k best (score, id) of each query so far; empty places hold the least score and the last id."""

    def __init__(self, queries: int, k: int, floor_score: np.ndarray | None = None, floor_id: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), _FEW)
        self.id = np.full((queries, k), _LAST)
        self.floor_score = np.full(queries, _FEW) if floor_score is None else floor_score
        self.floor_id = np.full(queries, _LAST) if floor_id is None else floor_id

    def threshold(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (score, id) that a candidate of query q has to beat."""
        s, i = self.score[q, -1], self.id[q, -1]
        fs, fi = self.floor_score[q], self.floor_id[q]
        higher = (fs > s) | (fs == s) & (fi < i)
        return np.where(higher, fs, s), np.where(higher, fi, i)

    def may_hold(self, q: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        s, i = self.threshold(q)
        return (bound > s) | (bound == s) & (least_id < i) | (s == _FEW)

    def add(self, q: np.ndarray, own_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer the candidates `ids` (columns of `scores`) to the queries `q` (rows), their own rows left out."""
        s, i = self.threshold(q)
        better = (scores > s[:, None]) | (scores == s[:, None]) & (ids[None] < i[:, None])
        better &= ids[None] != own_ids[:, None]
        row, col = np.nonzero(better)
        if not len(row):
            return
        row = np.concatenate([row, np.repeat(np.arange(len(q)), self.k)])
        score = np.concatenate([scores[better], self.score[q].reshape(-1)])
        cand = np.concatenate([ids[col], self.id[q].reshape(-1)])
        by = np.lexsort((cand, -score.astype(float), row)) if np.abs(score[score > _FEW]).max(initial=0) < 1 << 53 \
            else np.array(sorted(range(len(row)), key=lambda t: (row[t], -int(score[t]), cand[t])))
        row, score, cand = row[by], score[by], cand[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[q[row[top]], rank[top]] = score[top]
        self.id[q[row[top]], rank[top]] = cand[top]


def search_tree(tree: BallTree, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> int:
    """Branch and bound for all queries at once; gives the number of (query, vector) scores computed."""
    qf, points = queries.astype(float), x[tree.order]
    norms, point_ids = np.sqrt((qf ** 2).sum(1)), ids[tree.order]
    q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    leaves, computed = [], 0
    while len(q):                # one level at a time, only nodes that may still hold one of the k best
        bound = upper_bounds(qf[q], norms[q], tree.centre[node], tree.radius[node])
        keep = best.may_hold(q, bound, tree.least_id[node])
        q, node, bound = q[keep], node[keep], bound[keep]
        done = tree.children[node, 0] < 0
        leaves.append((q[done], node[done], bound[done]))
        q, node = np.repeat(q[~done], 2), tree.children[node[~done]].reshape(-1)
    q, node, bound = (np.concatenate(c) for c in zip(*leaves))
    by = np.lexsort((-bound, q))
    q, node, bound = q[by], node[by], bound[by]
    at = np.searchsorted(q, np.arange(len(queries)))
    end = np.searchsorted(q, np.arange(len(queries)), side="right")
    while True:                  # every query that isn't finished reads its next leaf
        active = np.flatnonzero(at < end)
        if not len(active):
            return computed
        pair = at[active]
        keep = best.may_hold(active, bound[pair], tree.least_id[node[pair]])
        s, _ = best.threshold(active)
        at[active[bound[pair] < s]] = end[active[bound[pair] < s]]      # later leaves have no higher bound
        at[active[bound[pair] >= s]] += 1
        active, pair = active[keep], pair[keep]
        by = np.argsort(node[pair], kind="stable")
        active, pair = active[by], pair[by]
        cut = np.flatnonzero(np.concatenate([[True], node[pair][1:] != node[pair][:-1]])) if len(pair) else []
        for a, b in zip(cut, list(cut[1:]) + [len(pair)]):
            n = node[pair[a]]
            rows = slice(tree.start[n], tree.end[n])
            who = active[a:b]
            best.add(who, query_ids[who], exact_products(queries[who], points[rows]), point_ids[rows])
            computed += len(who) * (rows.stop - rows.start)


_FOUND = "query_id long, vec_id long, score long"


def _found(best: Best, query_ids: np.ndarray) -> pa.Table:
    row, col = np.nonzero(best.id != _LAST)
    return pa.table({"query_id": pa.array(query_ids[row], pa.int64()), "vec_id": pa.array(best.id[row, col], pa.int64()),
                     "score": pa.array(best.score[row, col], pa.int64())})


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _rows(table: pa.Table, name: str = "x") -> np.ndarray:
    return matrix(table[name].combine_chunks())


def cells_of(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the leaves of a ball tree with about `cells` leaves."""
    points = np.unique(points, axis=0)
    tree = build(points, np.zeros(len(points), np.int64), max(1, -(-len(points) // cells)))
    return tree.centre[tree.children[:, 0] < 0]


def nearest_cell(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(half - points[a:a + 1024] @ centres.T).argmin(1) for a in range(0, len(points), 1024)] or [np.zeros(0, int)])


def search(vectors: DataFrame, queries, k: int = K, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that meets the condition `queries` on vec_id.

    `vectors(vec_id, x)` as given by `integer_vectors`.
    """
    spark = vectors.sparkSession
    vectors = same_dimension(common.stored(vectors, "integers"))
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
    shard_rows = max(shard_rows, -(-n // MAX_CELLS))
    centres = spark.sparkContext.broadcast(cells_of(_rows(points).astype(float), -(-n // shard_rows)))

    def cell(batches):
        for b in batches:
            near = nearest_cell(matrix(b.column(1)).astype(float), centres.value) if len(b) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())], ["vec_id", "x", "cell"])
    celled = common.stored(vectors.select("vec_id", "x").mapInArrow(cell, "vec_id long, x array<long>, cell int"), "cells")
    # a cell that is too large becomes several shards: MAX_CELLS rows at most
    parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    sharded = (celled.join(F.broadcast(parts), "cell")
               .select("vec_id", "x", F.concat_ws(":", "cell", F.pmod(F.xxhash64("vec_id"), "parts")).alias("shard")))
    asks = queries(F.col("vec_id"))

    def home(table: pa.Table) -> pa.Table:
        """The ball of the shard (kind 1), and the k best that its own queries find in it (kind 0)."""
        ids, x = _column(table, "vec_id"), _rows(table)
        tree, asked = build(x.astype(float), ids), _column(table, "asks")
        best = Best(int(asked.sum()), k)
        if asked.any():
            search_tree(tree, x, ids, x[asked], ids[asked], best)
        found = _found(best, ids[asked])
        m = len(found)
        ball = pa.table({"kind": pa.array([1], pa.int32()), "shard": pa.array([table["shard"][0].as_py()]),
                         "query_id": pa.array([0], pa.int64()), "vec_id": pa.array([tree.least_id[0]], pa.int64()),
                         "score": pa.array([0], pa.int64()), "centre": pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())),
                         "radius": pa.array([tree.radius[0]], pa.float64())})
        return pa.concat_tables([ball, pa.table({
            "kind": pa.array(np.zeros(m, np.int32)), "shard": pa.array([None] * m, pa.string()), "query_id": found["query_id"],
            "vec_id": found["vec_id"], "score": found["score"], "centre": pa.nulls(m, pa.list_(pa.float64())),
            "radius": pa.nulls(m, pa.float64())})])
    first = common.stored(sharded.withColumn("asks", asks).groupBy("shard").applyInArrow(
        home, "kind int, shard string, query_id long, vec_id long, score long, centre array<double>, radius double"), "home")
    # the balls: at most MAX_CELLS + n / shard_rows, that is 2 * MAX_CELLS, rows of one dimension each
    balls = first.filter("kind = 1").select("shard", "vec_id", "centre", "radius").orderBy("shard").toArrow()
    shards = spark.sparkContext.broadcast((balls["shard"].to_pylist(), _column(balls, "vec_id"), _rows(balls, "centre"),
                                           _column(balls, "radius")))
    found = first.filter("kind = 0").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = (found.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
              .select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id")))
    asked = sharded.filter(asks).join(floors, "vec_id", "left")

    def route(batches):
        """The shards, other than its own, that may improve a query's k best."""
        names, least, centre, radius = shards.value
        index = {s: i for i, s in enumerate(names)}
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1)).astype(float)
            norms, own = np.sqrt((x ** 2).sum(1)), np.array([index[s] for s in b.column(2).to_pylist()])
            best = Best(len(x), k, b.column(3).fill_null(_FEW).to_numpy(zero_copy_only=False),
                        b.column(4).fill_null(_LAST).to_numpy(zero_copy_only=False))
            rows, to = [], []
            for i in range(len(names)):
                q = np.flatnonzero(own != i)
                bound = upper_bounds(x[q], norms[q], centre[i], radius[i])
                q = q[best.may_hold(q, bound, np.full(len(q), least[i]))]
                rows.append(q)
                to.append(np.full(len(q), i))
            rows, to = pa.array(np.concatenate(rows)), np.concatenate(to)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(3).take(rows),
                                              b.column(4).take(rows), pa.array([names[i] for i in to], pa.string())],
                                             ["query_id", "q", "floor_score", "floor_id", "shard"])
    routed = asked.select("vec_id", "x", "shard", "floor_score", "floor_id").mapInArrow(
        route, "query_id long, q array<long>, floor_score long, floor_id long, shard string")
    # queries of a shard beyond a block go to other tasks, which read the shard again
    n_asked = vectors.filter(asks).count()
    blocks = max(1, -(-n_asked // block_queries))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    copies = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _found(Best(0, k), np.zeros(0, np.int64))
        ids, x, query_ids = _column(right, "vec_id"), _rows(right), _column(left, "query_id")
        best = Best(len(query_ids), k, left["floor_score"].combine_chunks().fill_null(_FEW).to_numpy(),
                    left["floor_id"].combine_chunks().fill_null(_LAST).to_numpy())
        search_tree(build(x.astype(float), ids), x, ids, _rows(left, "q"), query_ids, best)
        return _found(best, query_ids)
    others = routed.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(visit, _FOUND)
    return (found.union(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, lambda vec_id: vec_id % 50 == 0)
