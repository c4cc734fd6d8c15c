import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from matchday.llm.common import text_buffer
from matchday.llm.tokens import encoder, tokenizer_path, with_end

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
HARD = ["", " ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a \n b", "a\n\n\nb ", "don't we'll 's x's", "A,b.c!d's", "  x",
        "Été Ünï ﬁ İstanbul ΟΔΟΣ Σ", "é ́x", "a b c d", "x\x1cy", "12 345,6 a1b2", "—,“q”…", "<|endoftext|> a",
        "日本語 テスト", "a'", "!'s !x", "'tis '", "\t\tx\r\ny", "🙂🙂 x🙂", "ab" * 400, "Of%%% it's*** a.b,c", None]


def same(name, texts):
    e = encoder(name)
    ids, off = e.encode(*text_buffer(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == e.whole(t or ""), repr(t)


@pytest.mark.parametrize("name", FILES)
def test_hard_texts(name):
    same(name, HARD)
    same(name, HARD[::-1])
    same(name, [" ".join(x or "" for x in HARD)])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ É.,'’!s \n\t1 —Σ́")), max_size=30), max_size=5))
def test_random_texts(name, texts):
    same(name, texts)


def test_long_text_in_segments(monkeypatch):
    import matchday.llm.tokens as t
    monkeypatch.setattr(t, "LONG_TEXT", 50)
    monkeypatch.setattr(t, "CHUNK", 40)
    for name in FILES:
        same(name, ["some words, and \n more  words " * 20, "short"])


def test_end_ids():
    ids, off = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 1)
    assert ids.tolist() == [5, 6, 1, 1, 7, 1] and off.tolist() == [0, 3, 4, 6]


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_as_a_fresh_tokenizer_has_them(name, monkeypatch):
    import matchday.llm.tokens as t
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(tokenizer_path(name))
    texts = ["one two <|endoftext|> three", "plain words", "a<|endoftext|><|startoftext|>b ", "<|ENDOFTEXT|> x", "<|endof", "text|>",
             "<|endoftext|>", None, "", "<|endoftext|>\n\n<|endoftext|>", *HARD]
    want = [fresh.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[0] == {"word_bpe_49k.json": [637, 1237, 49407, 2097], "byte_bpe_50k.json": [505, 734, 220, 50256, 1115]}[name]
    for long in (t.LONG_TEXT, 10):
        monkeypatch.setattr(t, "LONG_TEXT", long)
        for one_by_one in (False, True):
            monkeypatch.setattr(t, "CHUNK", 1 if one_by_one else 1 << 20)
            ids, off = encoder(name).encode(*text_buffer(pa.array(texts, pa.string())))
            for i, w in enumerate(want):
                assert ids[off[i]:off[i + 1]].tolist() == w, repr(texts[i])


@pytest.mark.parametrize("name", FILES)
def test_cache_stays_within_its_bytes(name, monkeypatch):
    from matchday.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3 << 20)
    monkeypatch.setattr(tokens, "TABLE_BITS", 15)
    e = tokens.PieceEncoder(name)
    rng, sizes = np.random.default_rng(0), []
    for _ in range(6):
        texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(300)) for _ in range(20)]
        texts += ["x" * 300 + " y" * 9, "The the THE tHe"]
        ids, off = e.encode(*text_buffer(pa.array(texts)))
        sizes.append(e.cache_bytes())
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == e.whole(t)
    assert max(sizes) <= 3 << 20 and 2 * e.filled <= e.mask + 1
    # more distinct pieces in one text than the table holds
    many = " ".join("".join(p) for p in rng.permutation(np.array([f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"
                                                                 for c in "abcdefghijklmnopqrstuvwxyzé"])))
    ids, off = e.encode(*text_buffer(pa.array([many])))
    assert ids.tolist() == e.whole(many)
