import random

import numpy as np
import pyarrow as pa
import pytest

from matchday.llm import jaccard_join as jj
from matchday.llm.common import text_buffer
from matchday.llm.graph import components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None))
            for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    line, base = prose(12), prose(60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.55:
            t = list(base if rng.random() < 0.6 or not texts else rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(t[:rng.randint(0, 3) or len(t)] if rng.random() < 0.1 else t)
        else:
            texts.append(prose(rng.randint(0, 40)) + line * rng.randint(0, 1) + prose(rng.randint(0, 12)))
    out = [" ".join(t) for t in texts]
    return out + ["A b\tc D e f", "a b c d e f", "x", "X", "x y", None, "", " \n", "é É", "É é"]


def test_sets():
    texts = corpus(5, 50)
    got = jj.shingle_sets(*text_buffer(pa.array(texts)))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    one = [jj.shingle_sets(*text_buffer(pa.array([t])))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(got, one))
    assert all(np.all(g[1:] > g[:-1]) for g in got)


@pytest.mark.parametrize("probed", [0, 3, 3000])
def test_occurrence_search_equals_brute_force(probed):
    texts = [t for t in dict.fromkeys(corpus(2, 150)) if shingles(t)]
    sets = jj.shingle_sets(*text_buffer(pa.array(texts)))
    every = np.arange(len(sets))
    links = jj.occurrence_links(every, sets, every, every, probed=probed)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b)
        root[find(a)] = find(b)
    want = {d: c for d, _, c in brute(list(enumerate(texts)))}
    for i in every:
        for j in every[:i]:
            assert (find(i) == find(j)) == (want[i] == want[j])


def test_many_small_sets_cost_their_entries():
    owners = np.array([7, 7, 90_000, 7, 3])
    for n in (100_000, 90_001):
        who, count = jj._counted(owners, n, 2)
        assert who.tolist() == [7] and count.tolist() == [3]
    assert jj._counted(np.array([1, 1, 0]), 3, 1)[0].tolist() == [0, 1]
    # a chain of unions and one star
    joined = jj.Joined(30_000)
    assert all(joined.join(i, i + 1) for i in range(29_999)) and not joined.join(0, 29_999)
    assert len(set(joined.roots(np.arange(30_000)).tolist())) == 1
    # pairs of near copies of small sets: 40,000 sets in one block
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 60, (20_000, 10), dtype=np.uint64)
    near = base.copy()
    near[:, 0] += np.uint64(1)
    sets = [np.sort(s) for s in np.concatenate([base, near])]
    every = np.arange(len(sets))
    links = jj.occurrence_links(every, sets, every, every)
    assert sorted(tuple(sorted(x)) for x in links) == [(i, i + 20_000) for i in range(20_000)]


@pytest.mark.parametrize("block,short,hot", [(2_000_000, 32, 100), (400, 4, 10)])
def test_components_equal_brute_force(spark, monkeypatch, block, short, hot):
    monkeypatch.setattr(jj, "HOT_LIST", hot)
    texts = corpus(block, 260)
    rng = random.Random(0)
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (ids[0], texts[0]), (None, "only null here"), (None, texts[3]), (ids[5], "other text of the id")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, class string, size int")
    got = [tuple(r) for r in jj.near_duplicates(df.repartition(3), block=block, short=short).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.near_duplicates(df).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7), (500, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[300] == got[200] == got[100] == 100


def test_op3(spark):
    got = {tuple(r) for r in jj.op3_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert got == set(brute(rows))


def test_frequent_shingles_are_found_over_many_partitions(spark, monkeypatch):
    """Lines that are frequent in all, but come once in a partition, tie no texts together that have enough words of their own."""
    monkeypatch.setattr(jj, "HOT_LIST", 10)
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    lines = [prose(30) for _ in range(40)]
    texts = [" ".join(prose(60) + sum(rng.sample(lines, 2), [])) for _ in range(800)]
    rows = [*enumerate(texts), *((800 + i, texts[i] + " end") for i in range(0, 800, 80))]
    groups, tasks = [], jj._tasks

    def seen(nodes, *args):
        groups.extend(r["count"] for r in nodes.groupBy("label").count().collect())
        return tasks(nodes, *args)
    monkeypatch.setattr(jj, "_tasks", seen)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 100), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.near_duplicates(df, short=4).collect()}
    assert got == {i: i for i in range(800)} | {800 + i: i for i in range(0, 800, 80)}
    assert max(groups) < 200


def test_frequent_cells(spark, monkeypatch):
    texts = ["a b c d e f", *(f"own{i} a b c d e{i % 4}" for i in range(100))]
    df = spark.createDataFrame([(t,) for t in texts for _ in range(jj.SAMPLE)], "text string").coalesce(1)
    cells, grades = jj.frequent_cells(df)
    sets = jj.shingle_sets(*text_buffer(pa.array(texts)))
    every, n = np.unique(jj.cells_of(np.concatenate(sets)), return_counts=True)
    want = every[n * jj.SAMPLE > jj.HOT_LIST]
    assert cells.tolist() == want.tolist()
    counts = n[n * jj.SAMPLE > jj.HOT_LIST]
    assert all((grades[i] < grades[j]) == (counts[i] < counts[j]) for i in range(len(want)) for j in range(len(want)))
    monkeypatch.setattr(jj, "HOT_KEPT", 2)
    assert len(jj.frequent_cells(df)[0]) <= 2
