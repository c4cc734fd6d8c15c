import numpy as np
import pytest
from pyspark.sql import functions as F

from matchday.llm import mixing
from matchday.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def brute_rates(n, p, target, lam, steps):
    """Projected gradient in numpy, step for step."""
    w = n / n.sum()
    mass = (w[:, None] * p).sum(0)
    r = np.ones(len(n))
    for _ in range(steps):
        g = ((w * r) @ p - target) / mass
        r = np.maximum(0, r - (p @ g + lam * (r - 1)) / (1 + lam))
    return r


def test_rates_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.2, 0.1], 200)
    n = rng.integers(1, 500, 200)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    target = [0.7, 0.28, 0.02]
    pulls, reached = mixing.fit_rates(rows, target, steps=50, close=1e-7)
    assert np.allclose(reached, target, atol=2e-3)
    got = np.array([r[0] for r in rows.select(mixing.rate_of(F.col("p"), pulls)).collect()])
    want = brute_rates(n.astype(float), p, np.array(target), mixing.LAM, len(pulls))
    assert (got >= 0).all() and np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("soft,target", [([0.4, 0.2, 0.1], [0.7, 0.28, 0.02]), ([5.0, 2.0, 1.0], [0.9, 0.07, 0.03]),
                                         ([20.0, 0.05, 0.02], [0.5, 0.3, 0.2]), ([3.0, 3.0, 3.0], [0.0, 0.0, 1.0])])
def test_rates_are_the_optimum(spark, soft, target):
    """Against a brute force run until no rate moves, on soft, skewed and rare domains."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet(soft, 120)
    n = rng.integers(1, 500, 120)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    pulls, reached = mixing.best_rates(rows, target)
    got = np.array([r[0] for r in rows.select(mixing.rate_of(F.col("p"), pulls)).collect()])
    steps, want = 1000, brute_rates(n.astype(float), p, np.array(target), mixing.LAM, 1000)
    while steps < 300_000:
        steps, last = steps * 4, want
        want = brute_rates(n.astype(float), p, np.array(target), mixing.LAM, steps)
        if np.abs(want - last).max() < 1e-9:
            break
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(reached, ((n / n.sum() * want) @ p), atol=1e-7)


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.op4_mixing(spark, SF).toPandas()


def test_op4_rates_are_the_optimum(mixed):
    p, n = mixed[["p_clean", "p_low", "p_toxic"]].to_numpy(), mixed.tokens.to_numpy(float)
    want = brute_rates(n, p, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]), mixing.LAM, 3000)
    assert np.allclose(mixed.rate, want, atol=1e-5)


def test_op4_meets_its_targets(mixed):
    assert len(mixed) == 10_000
    for d, t in mixing.TARGETS.items():
        assert abs((mixed.tokens * mixed.rate * mixed[f"p_{d}"]).sum() / mixed.tokens.sum() - t) < 2e-3
    assert np.allclose(mixed[["p_clean", "p_low", "p_toxic"]].sum(axis=1), 1)
    assert abs((mixed.copies - mixed.rate).mean()) < 0.02 and ((mixed.copies - mixed.rate).abs() <= 1).all()


def test_posteriors_agree_with_the_labels(spark, mixed):
    got = mixed.merge(mixing.domain_of(read_table(spark, SF, "labels")).toPandas(), on="doc_id")
    best = got[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(1)
    assert (np.array(mixing.DOMAINS)[best] == got.domain).mean() > 0.93
    clean = got[got.domain == "clean"]
    assert (clean.copies > 0).mean() > 0.99 and (got[got.domain == "toxic"].copies > 0).mean() < 0.35


def test_resample_repeats_rows(spark, mixed):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.resample(docs, read_table(spark, SF, "labels"))
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in zip(mixed.doc_id, mixed.copies) if c}


def test_edges(spark):
    rows = [(1, None, "a", 1.0), (2, "", "b", 2.0), (None, "some clean words", "c", 3.0), (4, "word " * 30_000, None, 4.0),
            (4, "word " * 30_000, None, 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, p double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, none).collect()
    assert len(got) == 5 and all(r.rate == 1 and r.copies == 1 for r in got)
    assert mixing.resample(docs, none).columns == docs.columns and mixing.resample(docs, none).count() == 5
    some = spark.createDataFrame([(4, 1, 0), (4, 1, None), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(docs, some).count() == 5
    assert mixing.mixing_rates(docs.limit(0), none).count() == 0


def test_plan_has_no_python(spark):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        mixing.op4_mixing(spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
