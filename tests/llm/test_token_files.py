import zlib

import numpy as np
import pytest

from matchday.llm import orc_tokens, packing
from matchday.llm.tokens import encoder
from matchday.session import shared_dir

ROWS = [(3, "Anha, the of\n\nare haedre!", "x"), (1, None, "y"), (2, "", None), (7, "it's 12 o'clock " * 900, "z"),
        (7, "it's 12 o'clock " * 900, "z"), (7, "another", "z"), (None, "no id", "q"), (9, "é" * 5000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string").repartition(3)


def expected(name):
    e = encoder(name)
    return [(i, np.array([*e.whole(t or ""), 1], "<u4")) for i, t, _ in ROWS]


def test_orc_tokens(spark, docs):
    path = orc_tokens.write_tokens(docs, shared_dir(spark, "t"), partitions=3)
    got = orc_tokens.token_digests(orc_tokens.read_tokens(spark, path)).collect()
    want = expected("word_bpe_49k.json")
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 7, 7, 7, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    hit = spark.read.orc(path).filter("doc_id = 3")
    assert hit.count() == 1


def test_orc_empty(spark, docs):
    path = orc_tokens.write_tokens(docs.limit(0), shared_dir(spark, "t"))
    assert orc_tokens.token_digests(orc_tokens.read_tokens(spark, path)).count() == 0


def check_pieces(rows, want):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id in {i for i, _ in want}:
        texts = [x for i, x in want if i == doc_id]
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, texts))
        for r in by_doc[doc_id]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       for x in texts)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].sequence_length <= 2048 and at & (at - 1) == 0
    steps = {}
    for pieces in by_seq.values():
        steps.setdefault(pieces[0].step_group, []).append(pieces[0].sequence_length)
    assert all(len(set(x)) == 1 and sum(x) <= packing.STEP_TOKENS for x in steps.values())


@pytest.mark.parametrize("block", [100, 4_000_000])
def test_packing(docs, block):
    check_pieces(packing.pack(docs, block_tokens=block).collect(), expected("byte_bpe_50k.json"))


def test_packing_single_document_pieces_tile_it(spark):
    text = "word and more words, " * 3000
    rows = packing.pack(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.length
    assert at == rows[0].doc_tokens


def test_packing_empty(docs):
    assert packing.pack(docs.limit(0)).count() == 0


def test_tiers_are_filled_from_shorter_ones():
    pool = packing.Pool()
    for i, n in enumerate([1500, 700, 600, 300, 200, 100, 90, 50]):
        pool.add(i, 0, n)
    rows = list(packing.pack_block(pool, packing.TIERS, False))
    assert all(sum(p[2] for p in r) == size for size, r in rows)
    assert rows[0][0] == 2048 and rows[0][1][0] == (0, 0, 1500)
    assert pool.tokens < 256
