import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from matchday.llm import quality
from matchday.llm.common import text_buffer

SF = "/root/testdata/sf0.01"


def features(texts):
    return quality.featurize(*text_buffer(pa.array(texts, pa.string())), bits=8)


def test_scores_equal_the_sum_over_all_pairs():
    f = features(["One two two three!\nfour", "", None, "a | b | c", "x " * 300])
    rng = np.random.default_rng(1)
    size = (1 << 8) + len(quality.STATS)
    m = quality.Model(8, 0.3, rng.normal(size=size), rng.normal(size=(size, 3)), f.stats.mean(0), f.stats.std(0) + 1)
    x = np.zeros((5, size))
    x[f.rows, f.buckets] = f.values
    x[:, 1 << 8:] = m.dense(f.stats)
    for i in range(5):
        z = m.w0 + x[i] @ m.w
        on = np.flatnonzero(x[i])
        for a in range(len(on)):
            for b in range(a):
                z += m.v[on[a]] @ m.v[on[b]] * x[i, on[a]] * x[i, on[b]]
        assert math.isclose(m.margins(f)[i], z, rel_tol=1e-6, abs_tol=1e-9)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two two", "", "three, four\nthree, four\n", None, "é é É"]
    f = features(texts)
    for i, t in enumerate(texts):
        own = features([t])
        on = f.rows == i
        assert f.buckets[on].tolist() == own.buckets.tolist() and np.allclose(f.values[on], own.values)
        assert np.allclose(f.stats[i], own.stats[0])


def test_held_out_accuracy(spark):
    got = quality.op8_quality(spark, SF).toPandas()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    assert len(got) == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    again = quality.op8_quality(spark, SF).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0, "a"), (2, "", 1.0, "b"), (None, "Some text.", None, None),
                                  (4, "w " * 50_000, 2.0, "d"), (4, "w " * 50_000, 2.0, "d")],
                                 "doc_id long, text string, Score double, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(r.score > 0.99 for r in rows)
    assert quality.score(docs, model).columns == ["doc_id", "text", "label", "score"]
    one = spark.createDataFrame([(1, 0, 0), (2, 0, None), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_leaves_out_the_held_out(spark):
    labels = spark.range(2000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = [r.doc_id for r in quality.labelled_sample(labels, max_rows=100).collect()]
    assert len(got) == 100 and all(zlib.crc32(str(d).encode()) % 4 != 2 for d in got)


def test_rows_are_fitted_where_they_lie_in_the_types_they_come_in():
    texts = [f"{'good words here' if i % 2 else 'BAD | bad'} {i % 7}" for i in range(300)]
    f, y = features(texts), np.arange(300) % 2 * 1.0
    f.values = f.values.astype(np.float32).astype(np.float64)
    want = quality.fit(f, y, bits=8, steps=20)
    # the same rows, stored backwards, as numbers of 4 bytes
    at = np.searchsorted(f.rows, np.arange(301))
    counts = np.diff(at)[::-1]
    pos = quality.common.ragged(at[:-1][::-1], counts)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    got = quality._fit(starts[::-1], counts[::-1], f.buckets[pos].astype(np.int32), f.values[pos].astype(np.float32), f.stats, y, 8,
                       quality.FACTORS, 20)
    assert got.w0 == want.w0 and np.array_equal(got.w, want.w) and np.array_equal(got.v, want.v)
