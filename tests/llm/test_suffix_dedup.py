import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from matchday.llm import suffix_dedup as sd
from matchday.llm.common import text_buffer


def brute(texts, length, keep):
    """Maximal runs to remove of each text (bytes), texts in document order."""
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s:s + length], []).append((d, s))
    out = []
    for d, t in enumerate(texts):
        hit = [False] * len(t)
        for s in range(len(t) - length + 1):
            places = seen[t[s:s + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (d, s)):
                hit[s:s + length] = [True] * length
        runs, at = [], 0
        while at < len(t):
            if hit[at]:
                end = at
                while end < len(t) and hit[end]:
                    end += 1
                runs.append((at, end))
                at = end
            at += 1
        out.append(runs)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(8, 40)) for _ in range(6)]
    line = prose(7)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.3 and texts:
            t = rng.choice(texts)
            texts.append(t[:len(t) // 2] + prose(3) + t[len(t) // 2:])
        else:
            parts = [prose(rng.randint(1, 30))]
            for _ in range(rng.randint(0, 3)):
                parts += [rng.choice([*shared, line, line]), prose(rng.randint(0, 12))]
            texts.append(" ".join(parts))
    texts += ["a" * 500, "ab " * 200, "ab " * 90, "", "x" * 99, "z" * 100, "z" * 101]
    return texts


def test_every_window_is_in_one_fragment_with_its_key():
    texts = corpus(1)
    buf, off = text_buffer(pa.array(texts))
    text, lo, hi, key, alone = sd.fragments(buf, off, 100)
    keys = {}
    windows = 0
    for t, a, b, k in zip(text, lo, hi, key):
        assert off[t] <= a and b <= off[t + 1]
        for s in range(a, b - 99):
            windows += 1
            assert keys.setdefault(buf[s:s + 100].tobytes(), k) == k
    assert windows == sum(max(0, len(t.encode()) - 99) for t in texts)


def test_suffix_order_and_smaller_positions():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    raw = text.tobytes()
    order, rank = sd.suffix_order(text, 20)
    inside = [i for i in order.tolist() if i + 20 <= 400]
    assert inside == sorted(range(381), key=lambda i: (raw[i:i + 20], i))
    before = sd._smaller_before(order)
    for i in range(400):
        want = max((j for j in range(i) if order[j] < order[i]), default=-1)
        assert before[i] == want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bucket", [1 << 20, 3000, 200])
def test_spans_equal_brute_force(spark, keep, bucket):
    texts = corpus(bucket)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.c0: sd.merged_spans(r.spans) for r in sd.with_spans(df, 100, keep, bucket).collect()}
    want = brute([t.encode() for t in texts], 100, keep)
    assert [got[i] for i in range(len(texts))] == want


def test_edges(spark):
    long = "some words that are long enough to count, é and more " * 4
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, long, "c", 3), (5, long, "d", 4), (5, long, "d", 4), (6, "own " + long, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, _did int")
    got = sd.remove_repeats(df, 200).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "key", "_did"]
    texts = {(r.doc_id, r.key): r.text for r in got}
    assert len(got) == 6 and texts[1, "a"] is None and texts[2, "b"] == "" and texts[None, "c"] == long
    assert texts[5, "d"] == "" and texts[6, "e"] == "own "
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_whole_characters():
    raw = "aéé".encode()
    assert sd.whole_characters(raw, [(2, 4)]) == [] and sd.whole_characters(raw, [(0, 4)]) == [(0, 3)]
    assert sd.whole_characters(raw, [(2, 5)]) == [(3, 5)]


def test_op1(spark):
    got = {r.doc_id: r for r in sd.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text.encode() for r in rows]
    for r, t, runs in zip(rows, texts, brute(texts, 200, "none")):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(t), sum(b - a for a, b in runs), len(runs))
        assert g.kept_sha256 == hashlib.sha256(sd.kept_bytes(t, runs)).hexdigest()
    assert sum(g.n_spans for g in got.values()) > 10
