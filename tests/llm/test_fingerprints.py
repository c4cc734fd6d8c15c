import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchday.llm import fingerprints as fp


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, text string")


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_syncmers_equal_brute_force(spark):
    texts = [" ".join(prose(1, 80)), "a b c d", "a b c d e", "", "one", " x\n\ty  z\rq w v ", "a a a a a a a a"]
    df = rows_of(spark, texts).withColumn("h", fp.word_hashes(F.col("text"))).withColumn("s", fp.syncmers(F.col("h")))
    flat = [(w,) for t in texts for w in t.split()]
    own = {r.w: r.h for r in spark.createDataFrame(flat, "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    rows = df.orderBy("i").collect()
    pairs = {(a, b) for t in texts for a, b in zip(t.split(), t.split()[1:])}
    ph = {(r.a, r.b): r.h for r in spark.createDataFrame([(own[a], own[b]) for a, b in pairs], "a long, b long")
          .select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for t, r in zip(texts, rows):
        h = [own[w] for w in t.split()]
        assert r.h == h
        want = []
        for i in range(len(h) - 4):
            s = [ph[h[i + j], h[i + j + 1]] for j in range(4)]
            if min(s) in (s[0], s[3]):
                want.append(i)
        assert [x.place for x in r.s] == want


def test_choice_does_not_depend_on_context(spark):
    middle = prose(2, 40)
    a, b = prose(3, 20) + middle + prose(4, 9), prose(5, 7) + middle
    got = rows_of(spark, [" ".join(a), " ".join(b)]).select(fp.syncmers(fp.word_hashes(F.col("text"))).alias("s")).collect()
    inside = [[(x.place - at, x.hash) for x in r.s if at <= x.place <= at + 35] for r, at in zip(got, (20, 7))]
    assert inside[0] == inside[1] and len(inside[0]) > 5


def brute_edit(texts):
    out = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        out.append(t[:len(t) - half] + nxt[:half])
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_texts(spark, parts):
    rng = random.Random(7)
    texts = [" ".join(prose(i, rng.randint(0, 300))) for i in range(60)] + [None, "", "é🙂ß" * 5, "one", "one"]
    ids = sorted(rng.sample(range(-50, 5000), len(texts)))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, own string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df.repartition(parts)).collect()}
    edited = brute_edit(texts)
    assert len(got) == len(ids)
    for i, t, e in zip(ids, texts, edited):
        assert got[i].n_chars == len(t or "") and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[ids[-1]].fingerprint == got[ids[-2]].fingerprint and got[ids[-2]].near_next == 1
    long = [i for i, t in zip(ids, texts) if t and len(t.split()) > 60]
    near = [got[i].near_edited for i in long]
    assert 0.2 < sum(near) / len(near) < 0.5 and all(got[i].near_edited > got[i].near_next for i in long)
    assert got[ids[61]].fingerprint == "" and len(got[long[0]].fingerprint) % 8 == 0


def test_same_ids_and_nulls(spark):
    rows = [(None, "a b c d e f g"), (1, "x y"), (1, "z"), (1, "z"), (3, None)]
    got = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 1, 1, 3, 13]
    one = fp.edited_fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_spaces_have_anchors(spark):
    rng = random.Random(5)
    signs = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(400)) for _ in range(6)] + ["🙂é" * 40, "短い文です"]
    df = spark.createDataFrame(list(enumerate(signs)), "doc_id long, text string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    assert all(0.15 < got[i].near_edited < 0.6 and got[i].near_next == 0 for i in range(6))
    assert all(got[i].shift_edited == 0 and got[i].aligned_edited > 8 for i in range(6))
    assert [r.n for r in df.select(F.size(fp.word_hashes("text")).alias("n")).orderBy("doc_id").collect()][:7] == [400] * 6 + [80]


def test_anchors_line_moved_passages_up(spark):
    """Against brute force: shared hashes by place, the shift that most of them have."""
    base, other = prose(11, 300), prose(12, 300)
    texts = [" ".join(x) for x in (base, prose(13, 37) + base[40:], other, base[150:] + base[:150], [], base[:3])]
    rows = rows_of(spark, texts).select("i", fp.anchors(F.col("text")).alias("a"), fp.sketch(F.col("text")).alias("s"))
    rows = rows.select(F.col("i"), "a", "s").collect()
    places = {r.i: {x.hash: x.place for x in r.a} for r in rows}
    assert all([x.hash for x in r.a] == r.s == sorted(set(r.s)) for r in rows)
    pairs = [(i, j) for i in places for j in places]
    a = rows_of(spark, texts).select(F.col("i"), fp.anchors(F.col("text")).alias("a"))
    b = a.select(F.col("i").alias("j"), F.col("a").alias("b"))
    both = spark.createDataFrame(pairs, "i long, j long").join(a, "i").join(b, "j")
    for r in both.select("i", "j", fp.aligned(F.col("a"), F.col("b")).alias("at")).collect():
        votes = [places[r.j][h] - places[r.i][h] for h in places[r.i] if h in places[r.j]]
        best = max(set(votes), key=lambda v: (votes.count(v), -abs(v), -v), default=None)
        assert (r["at"]["shift"], r["at"]["anchors"]) == (best, votes.count(best)), (r.i, r.j)
        if (r.i, r.j) == (0, 1):
            assert best == -3 and votes.count(best) > 30


def test_likeness_equals_brute_force(spark):
    texts = [" ".join(prose(i, 40 + 30 * i)) for i in range(5)]
    texts += [texts[4][:300], " ".join(texts[:2]), "", "x", None]
    got = {r.i: r.s for r in rows_of(spark, texts).select("i", fp.sketch(F.col("text")).alias("s")).collect()}
    a = rows_of(spark, texts).select("i", fp.sketch(F.col("text")).alias("a"))
    b = a.select(F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = spark.createDataFrame([(i, j) for i in got for j in got], "i long, j long").join(a, "i").join(b, "j")
    for r in pairs.select("i", "j", fp.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        least = sorted(set(got[r.i]) | set(got[r.j]))[:fp.KEPT]
        common = set(got[r.i]) & set(got[r.j]) & set(least)
        assert r.near == (len(common) / len(least) if least else 1.0)


def test_plan_has_no_python(spark):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        fp.op5_fingerprints(spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
