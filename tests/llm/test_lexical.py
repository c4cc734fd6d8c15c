import math
import re
from collections import Counter

import numpy as np
import pytest

from matchday.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    tfs = [(i, Counter(words(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, total = len(tfs), sum(n for _, _, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c, n in tfs:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3, **more):
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), **more).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str)


def random_texts(rng, count, vocabulary, longest):
    names = np.array([f"w{i}" if i % 3 else f"Ñ{i}é" for i in range(vocabulary)])
    p = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(rng.choice(names, rng.integers(0, longest), p=p / p.sum())) for _ in range(count)]


@pytest.mark.parametrize("seed, more", [(0, {}), (1, {"k": 3, "group_terms": 60}), (2, {"k": 1, "group_items": 7})])
def test_equals_brute_force(spark, monkeypatch, seed, more):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 70)
    monkeypatch.setattr(lexical, "CELLS", 300)
    monkeypatch.setattr(lexical, "FIRST", 2)
    rng = np.random.default_rng(seed)
    texts = random_texts(rng, 300, 400, 60)
    texts[100:200] = [texts[99]] * 100                      # a third of all rows are one text
    docs = list(enumerate(texts))
    items = list(enumerate(random_texts(rng, 40, 400, 12) + [texts[5], texts[7], texts[99]]))
    assert run(spark, docs, items, **more) == brute(docs, items, more.get("k", 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;\x00"), (4, "Ab aB,AB-x"), (5, "ab"), (5, "ab"), (None, "ab"), (6, "x ÉÉ éé 日本"), (7, "Straße ab " + "z " * 50_000)]
    items = [(1, "AB"), (1, "x"), (2, None), (3, "..."), (None, "日本 É"), (4, "éé nothing"), (5, "ab ab ab"), (6, "unknown")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items[:0] or [(9, None)]) == []
    assert lexical.search(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
    assert lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    clash = lexical.search(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as n", "'t' as terms", "2 as item"),
                           spark.createDataFrame(items, ITEMS).selectExpr("*", "3 as doc_id")).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in clash), key=str) == brute(docs, items)


def test_bounds_give_up_pairs():
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(30), 60)                     # documents about one of 30 subjects of 20 terms
    term = np.concatenate([np.sort(rng.choice(20, 8, replace=False)) + 20 * g for g in group])
    ends = np.arange(len(group) + 1) * 8
    value = rng.integers(1, 1000, len(term))
    owner = np.repeat(np.arange(60), 6)
    item_term = np.concatenate([np.sort(rng.choice(20, 6, replace=False)) + 20 * (i // 2) for i in range(60)])
    weights = rng.integers(1, 50, 600)
    best = lexical.TopK(np.zeros(60, np.int64), 5)
    trees = list(lexical.item_trees(owner, item_term, weights))
    computed = lexical.search_block(trees, ends, term, value, np.arange(len(group)), best)
    assert computed < 60 * len(group) / 10
    for i in range(60):
        mine = set(item_term[owner == i].tolist())
        scores = sorted((-sum(int(weights[t]) * int(v) for t, v in zip(term[a:a + 8], value[a:a + 8]) if t in mine), d)
                        for d, a in enumerate(ends[:-1]))[:5]
        assert [(-s, d) for s, d in scores] == list(zip(best.score[i].tolist(), best.row[i].tolist()))
