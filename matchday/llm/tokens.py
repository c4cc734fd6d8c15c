"""Token ids of whole texts with the `tokenizers` library, at word speed.

A pre-tokenizer never lets a token cross certain places (white space, a letter
next to punctuation). Text is cut there with numpy, each distinct piece is
encoded once by the library and looked up afterwards. Texts with white space
outside ASCII or with an added token (such as `<|endoftext|>`, which the
tokenizer takes out before it cuts), and tokenizers of another build, are
encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .common import U64, byte_table, mix, ragged, row_chunks, run_hashes

CHUNK = 1 << 20          # bytes cut at a time
CACHE_BYTES = 64 << 20   # the pieces' cache is emptied before it exceeds this
TABLE_BITS = 20          # of its hash table, which is at most half full
LONG_TEXT = 1 << 22      # longer texts are encoded in safe segments
LONG_PIECE = 256         # longer pieces are not kept

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def tokenizer_path(name: str) -> str:
    """A file's place: a path as it is, else a name of the installed vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _odd_space(buf: np.ndarray) -> np.ndarray:
    """Positions of white space or separators that only Unicode rules know."""
    odd = (buf >= 0x1C) & (buf <= 0x1F)
    high = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    high = high[high + 2 < len(buf) + 1]
    at = [np.flatnonzero(odd)]
    if len(high):
        pad = np.concatenate([buf, np.zeros(2, np.uint8)])
        a, b, c = pad[high], pad[high + 1], pad[high + 2]
        hit = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))
               | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
               | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
                                | (b == 0x81) & ((c == 0x9F) | (c == 0xA0)))
               | (a == 0xE3) & (b == 0x80) & (c == 0x80))
        at.append(high[hit])
    return np.sort(np.concatenate(at))


class PieceEncoder:
    """`encode(bytes, offsets)` gives the same ids as `Tokenizer.encode` of each text."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer
        self.path = tokenizer_path(name)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] \
                and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.kind = "word"
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        if self.kind == "word" and any(not t.isascii() or set(t.lower()) & set(b"k;` \t\n\r\x0b\x0c") for t in self.added):
            self.kind = "whole"      # the normalizer can make these out of other characters
        self.added = [t.lower() if self.kind == "word" else t for t in self.added]
        table = byte_table(11)
        self.symbols = table[_LOWER] if self.kind == "word" else table
        self.model = self.tokenizer.model
        self._reset()

    def _reset(self) -> None:
        self.mask = (1 << TABLE_BITS) - 1
        self.keys = np.zeros(self.mask + 1, U64)
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.count = 0
        self.starts = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.filled = 0                      # places of the table taken

    def cache_bytes(self) -> int:
        """Memory of the pieces that are kept."""
        return sum(a.nbytes for a in (self.keys, self.slots, self.starts, self.lengths, self.flat))

    def _full(self, pieces: int, size: int) -> bool:
        """Whether `pieces` more of `size` bytes in all (an id for each at most) could exceed the cache's bounds."""
        kept = lambda have, more: (max(have, 1) if more <= have else 1 << (more - 1).bit_length())
        arrays = 8 * kept(len(self.starts), self.count + pieces) + 4 * kept(len(self.flat), self.used + size)
        return 2 * (self.count + pieces) > self.mask or self.keys.nbytes + self.slots.nbytes + arrays > CACHE_BYTES

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _added_at(self, buf: np.ndarray) -> np.ndarray:
        """Positions of added tokens, in any case where the normalizer lowers it; none is missed."""
        raw, at = (_LOWER[buf] if self.kind == "word" else buf).tobytes(), []
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                at.append(i)
                i = raw.find(token, i + 1)
        return np.array(sorted(at), np.int64)

    def _apart(self, buf: np.ndarray) -> np.ndarray:
        """Positions of what makes a text one to encode whole."""
        return np.concatenate([_odd_space(buf), self._added_at(buf)])

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece; words of letters go straight to the merges."""
        if self.kind == "word":
            low = piece.lower()
            plain = low.isascii() and low.isalpha()
            if not plain and (not low.isalpha() or "Σ" in piece or not unicodedata.is_normalized("NFC", piece)
                              or not unicodedata.is_normalized("NFC", low)):
                return self.whole(piece)
            piece = low
        else:
            body = piece[1:] if piece[:1] == " " else piece
            if not body.isalpha():
                return self.whole(piece)
            plain = False
        shown = piece if plain else "".join(map(_ALPHABET.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def _add(self, ids: list[int]) -> int:
        k, n = self.count, len(ids)
        if k == len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[k], self.lengths[k] = self.used, n
        self.flat[self.used:self.used + n] = ids
        self.used += n
        self.count += 1
        return k

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not in the table."""
        out = np.full(len(h), -1, np.int32)
        todo, at = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[at] == h[todo])
            out[todo[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out

    def _insert(self, h: np.ndarray, slots: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        todo, at = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            place, first = np.unique(at, return_index=True)       # one for each place, if it is free
            free = self.slots[place] < 0
            place, who = place[free], todo[first[free]]
            self.keys[place], self.slots[place] = h[who], slots[who]
            left = ~np.isin(todo, who)
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _cut(self, buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; `first` marks the first byte of each text."""
        n = len(buf)
        ws, letter, punct = _WS[buf], _LETTER[buf], _PUNCT[buf]
        before = np.concatenate([[True], ws[:-1]]) | first[:n]
        edge = np.zeros(n, bool)
        edge[1:] = letter[:-1] & punct[1:] | punct[:-1] & letter[1:]
        if self.kind == "word":
            start = ~ws & (before | edge)
            stop = ~ws
            stop[:-1] &= ws[1:] | start[1:] | first[1:n]
            return np.flatnonzero(start), np.flatnonzero(stop) + 1
        last_ws = np.zeros(n, bool)          # white space right before a word
        last_ws[:-1] = ws[:-1] & ~ws[1:] & ~first[1:n]
        glued = np.zeros(n, bool)            # the byte before is a space that joins this word
        glued[1:] = last_ws[:-1] & (buf[:-1] == 32)
        ws_before = np.concatenate([[False], ws[:-1]]) & ~first[:n]
        start = first[:n] | last_ws | ws & ~ws_before | ~ws & ws_before & ~glued | edge
        start[0] = True
        at = np.flatnonzero(start)
        return at, np.concatenate([at[1:], [n]])

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, texts = len(buf), len(offsets) - 1
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        starts, ends = self._cut(buf, first)
        h = run_hashes(self.symbols[buf], starts, ends)
        slots = self._lookup(h)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            uniq, index, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.count and self._full(len(uniq), int((ends - starts)[miss[index]].sum())):
                self._reset()                                     # what this chunk knew goes too
                return self._chunk(buf, offsets)
            raw, new = buf.tobytes(), np.empty(len(uniq), np.int32)
            s, e = starts[miss[index]].tolist(), ends[miss[index]].tolist()
            for i in range(len(uniq)):
                new[i] = self._add(self._piece(raw[s[i]:e[i]].decode("utf-8", "replace")))
            keep = (ends - starts)[miss[index]] <= LONG_PIECE
            keep &= np.cumsum(keep) <= self.mask // 2 - self.filled
            self.filled += int(keep.sum())
            self._insert(uniq[keep], new[keep])
            slots[miss] = new[inverse]
        lengths = self.lengths[slots].astype(np.int64)
        ids = self.flat[ragged(self.starts[slots], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        bounds = sums[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into ids) of texts given as bytes with offsets."""
        parts, counts = [], []
        for a, b in row_chunks(offsets, CHUNK):
            lo, hi = int(offsets[a]), int(offsets[b])
            part, own = buf[lo:hi], offsets[a:b + 1] - lo
            if self.kind == "whole":
                ids, n = self._each(part, own, range(b - a))
            elif b - a == 1 and hi - lo > LONG_TEXT:
                ids, n = self._long(part)
            else:
                ids, n = self._chunk(part, own)
                odd = self._apart(part)
                if len(odd):
                    ids, n = self._each(part, own, set(np.searchsorted(own, odd, side="right") - 1), ids, n)
            parts.append(ids)
            counts.append(n)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _each(self, buf, offsets, rows, ids=None, counts=None):
        """Encode `rows` whole, keep the other rows' ids."""
        rows = set(map(int, rows))
        sums = None if ids is None else np.concatenate([[0], np.cumsum(counts)])
        out = []
        for i in range(len(offsets) - 1):
            if i in rows:
                text = buf[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                out.append(np.array(self.whole(text), np.uint32))
            else:
                out.append(ids[sums[i]:sums[i + 1]])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.array([len(x) for x in out], np.int64)

    def _long(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A very long text, segment by segment, cut at a space between two ASCII letters."""
        if len(self._apart(buf)):
            return self._each(buf, np.array([0, len(buf)]), {0})
        ok = np.flatnonzero((buf[1:-1] == 32) & _LETTER[buf[:-2]] & _LETTER[buf[2:]]) + 1
        cuts, at = [0], CHUNK
        while at < len(buf):
            i = int(np.searchsorted(ok, at))
            if i == len(ok):
                break
            cuts.append(int(ok[i]))
            at = int(ok[i]) + CHUNK
        cuts.append(len(buf))
        out = [self._chunk(buf[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate(out)
        return ids, np.array([len(ids)], np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """One encoder per file and process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append `end_id` to each text."""
    n = len(offsets) - 1
    out = np.insert(ids, offsets[1:], np.uint32(end_id)) if n else ids
    return out.astype(np.uint32, copy=False), offsets + np.arange(n + 1)
