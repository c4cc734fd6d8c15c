"""Nearest neighbours (operator 7): adaptive dimension scan inside the lists of an inverted file.

All vectors are put into the list of their nearest centroid (centroids are
fitted on a bounded sample). A query reads the vectors of its nearest lists.
Vectors are turned by a random rotation and laid out in blocks of dimensions;
after each block a hypothesis test on the partial distance gives up the
candidates that will, but for a small error, not come among the k nearest. What
survives is compared exactly, on the original vectors in double precision.

Lists are cut into blocks of bounded size by the hash of `vec_id`, so that a
list which holds many equal vectors is searched by many tasks; each gives its k
best, and these are merged by query.

Defined results: a vector that is null, zero, holds null or non-finite
components or has another dimension than most takes no part, nor does a null
id; of several rows with one id the smallest vector counts, once; ties go to
the smaller id; a query reads more lists until they hold k candidates, so that
all candidates are returned if there are fewer; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.tables import read_table
from . import common

K = 10
SAMPLE = 20_000        # vectors that centroids are fitted on, at most
MAX_LISTS = 4096
RECALL = 0.97          # aimed at when the number of lists to read is chosen
BLOCK_ROWS = 4096      # candidates of a task's block, about
BLOCK_QUERIES = 4096   # queries of a task's block, about
EPSILON = 2.1          # of the hypothesis test: larger keeps more candidates
DIMS = 16              # dimensions between two tests


@dataclass
class Index:
    """Centroids and the rotation: numbers bounded by MAX_LISTS and the dimension."""
    centroids: np.ndarray
    rotation: np.ndarray


def valid_vectors(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    ok = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
          & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("v", lambda x: x != 0))
    rows = rows.filter(F.coalesce(ok, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def fit(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 0) -> Index:
    """k-means on the sample, and a random rotation."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0]
    points = np.unique(sample, axis=0)
    centroids = points[rng.permutation(len(points))[:lists]]
    for _ in range(rounds):
        near = nearest_lists(points, centroids, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.stack([np.bincount(near, weights=points[:, j], minlength=len(centroids))
                         for j in range(points.shape[1])], 1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return Index(centroids, rotation)


def nearest_lists(points: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each point, nearest first."""
    out = []
    for lo in range(0, len(points), 2048):
        d = (centroids ** 2).sum(1)[None] - 2 * points[lo:lo + 2048] @ centroids.T
        out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def enough_probes(points: np.ndarray, centroids: np.ndarray, k: int, target: float, asked: int = 200) -> int:
    """Lists to read so that, on the sample, the k nearest of `asked` points are found with recall `target`."""
    lists, step = len(centroids), max(1, len(points) // asked)
    own = nearest_lists(points, centroids, 1)[:, 0]
    ranks = []
    for i in range(0, len(points), step):
        d = ((points - points[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d)) - 1)[:k]
        order = nearest_lists(points[i:i + 1], centroids, lists)[0]
        place = np.empty(lists, np.int64)
        place[order] = np.arange(lists)
        ranks.append(place[own[near]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan_block(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
               k: int, epsilon: float = EPSILON) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of the k best candidates of the block for each query."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    turned = np.ascontiguousarray((vectors @ index.rotation).T)      # one row per dimension
    dims, out = len(turned), []
    for qid, q in zip(query_ids.tolist(), queries):
        tq = q @ index.rotation
        left = np.flatnonzero(ids != qid)
        if len(left) > 4 * k:
            # the k best of the first candidates bound the k-th distance
            first = left[:: max(1, len(left) // (4 * k))]
            bound = np.partition(((vectors[first] - q) ** 2).sum(1), k - 1)[k - 1]
            partial = np.zeros(len(left))
            for d in range(0, dims, DIMS):
                to = min(d + DIMS, dims)
                cols = turned[d:to, left] if len(left) < len(ids) else turned[d:to]
                partial = partial + ((cols - tq[d:to, None]) ** 2).sum(0)
                # reject "the distance is within the bound" when the scaled partial distance is far above it
                limit = bound * (to / dims) * (1 + epsilon / np.sqrt(to)) ** 2 if to < dims else bound
                keep = partial <= limit * (1 + 1e-9) + 1e-12
                left, partial = left[keep], partial[keep]
        d = np.sqrt(((vectors[left] - q) ** 2).sum(1))
        best = np.lexsort((ids[left], d))[:k]
        out.extend((qid, int(i), float(s)) for i, s in zip(ids[left[best]], d[best]))
    return out


def search(vectors: DataFrame, queries, k: int = K, lists: int | None = None, probes: int | None = None,
           recall: float = RECALL, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row that meets the condition `queries` on vec_id.

    `vectors` as given by `valid_vectors`. By default there are about sqrt(n)
    lists, and a query reads as many as give `recall` on the sample.
    """
    spark = vectors.sparkSession
    vectors = common.checkpointed(vectors)
    shape = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    vectors = vectors.filter(F.size("v") == shape["d"])
    n = shape["count"]
    points = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().combine_chunks()
    points = _matrix(points.column("v").combine_chunks())
    lists = lists or int(min(MAX_LISTS, max(1, round(np.sqrt(n)))))
    index = fit(points, lists)
    lists = len(index.centroids)
    probes = min(lists, probes or max(8, enough_probes(points, index.centroids, k, recall)))
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest_lists(_matrix(b.column(1)), shared.value.centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())],
                                             ["vec_id", "v", "list"])

    listed = common.checkpointed(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():       # one row per list
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = nearest_lists(_matrix(b.column(1)), shared.value.centroids, lists)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            rows, cols = np.nonzero((np.arange(lists)[None] < probes) | (before < k + 1))
            near = order[rows, cols]
            full = sizes[near] > 0
            rows, near = rows[full], near[full]
            each = blocks[near]
            rows, near = np.repeat(rows, each), np.repeat(near, each)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(near, pa.int32()),
                 pa.array(block, pa.int32())], ["query_id", "q", "list", "block"])

    asked = common.checkpointed(listed.filter(queries(F.col("vec_id"))).select("vec_id", "v")
                                .mapInArrow(probe, "query_id long, q array<double>, list int, block int"))
    # queries that ask a list beyond `block_queries` are dealt to parts, each of which meets the list's whole block
    parts = np.ones(lists, np.int64)
    for r in asked.filter("block = 0").groupBy("list").count().collect():      # one row per list
        parts[r["list"]] = -(-r["count"] // block_queries)
    table = spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(blocks, parts))], "list int, blocks int, parts int")
    table = F.broadcast(table)                                # MAX_LISTS rows
    asked = asked.join(table, "list").select("query_id", "q", "list", "block",
                                             F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
    cut = listed.join(table, "list").select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
                                            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def scan(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(c):
            rows = scan_block(shared.value, c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy()),
                              q["query_id"].to_numpy(), np.stack(q["q"].to_numpy()), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "block", "part"]
    best = asked.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(
        scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (best.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, lambda vec_id: vec_id % 100 == 0)
