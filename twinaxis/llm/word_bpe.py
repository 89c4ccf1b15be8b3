"""Token ids of the public lower-casing word BPE vocabulary.

The library's own encoder takes about 20 microseconds for a word it has not
seen lately. Texts of Latin letters and ASCII white space, for which
normalization is plain lower-casing, are therefore cut at white space; each
distinct piece is encoded by the same merges and kept in a bounded table, which
serves all tasks of a worker. Every other text, and one that may hold a special token, goes to the
library whole. Both ways give the same ids (tests compare them).
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import re

import numpy as np

#: Latin letters, ASCII and general punctuation; no character here is changed by NFC or lower-cased by context.
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ɏ‐-‧‰-⁞]*")
_LETTER, _NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Entries of the table; a fuller one keeps the first half, in which the common words are.
_KEPT = 500_000
_NEVER = 1 << 40
_TABLE_BITS = 19


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Merges:
    """The merges as an open-addressed table that whole arrays look up: pair of ids -> rank << 16 | new id."""

    def __init__(self, merges: dict[int, int]):
        keys = np.array(list(merges), np.int64)
        self.keys = np.full(1 << _TABLE_BITS, -1, np.int64)
        self.values = np.full(1 << _TABLE_BITS, _NEVER, np.int64)
        at, values = self._place(keys), np.array(list(merges.values()), np.int64)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape
        keys = np.where((a < 0) | (b < 0), -1, a << 16 | b).ravel()
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NEVER)
        out[keys < 0] = _NEVER
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = open_[found == keys[open_]]
            out[hit] = self.values[at[hit]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return out.reshape(shape)


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters])
        self._last = np.array([vocab[c + end] for c in letters])
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a] << 16 | vocab[b]] = rank << 16 | vocab[a + b]
        self._merges = _Merges(merges)
        #: Pieces between white space and the parts of those that are no single word; a part alone is a piece.
        self._pieces: dict[str, bytes] = {}

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of many words at once: every round merges each word's first pair of the lowest rank."""
        parts = sorted(parts, key=len)
        raw = [p.encode() for p in parts]
        out: dict[str, bytes] = {}
        at = 0
        while at < len(raw):
            # Words of similar length share a matrix.
            width = max(4, len(raw[at]) * 3 // 2)
            to = at
            while to < len(raw) and len(raw[to]) <= width and (to - at) * width < 1 << 20:
                to += 1
            part, names = raw[at:to], parts[at:to]
            at = to
            n, size = len(part), np.array([len(r) for r in part])
            wide = int(size.max())
            flat = np.frombuffer(b"".join(part), np.uint8)
            ids = np.full((n, wide + 1), -1, np.int64)
            inside = np.arange(wide + 1) < size[:, None]
            ids[inside] = self._inner[flat]
            ends = np.cumsum(size) - 1
            ids[np.arange(n), size - 1] = self._last[flat[ends]]
            pairs = self._merges.of(ids[:, :-1], ids[:, 1:]) if wide > 1 else np.full((n, 1), _NEVER)
            row, place = np.arange(n), np.arange(pairs.shape[1])
            done = ids
            while len(row):
                i = pairs.argmin(axis=1)
                least = pairs[np.arange(len(row)), i]
                live = least < _NEVER
                done[row[~live]] = ids[~live]
                row, ids, pairs, i, least = row[live], ids[live], pairs[live], i[live], least[live]
                if not len(row):
                    break
                k = np.arange(len(row))
                ids[k, i] = least & 0xFFFF
                step = place + (place > i[:, None])  # the id after i goes, those behind it move up
                ids = np.concatenate([np.take_along_axis(ids, step, 1), np.full((len(row), 1), -1)], axis=1)
                pairs = np.take_along_axis(np.concatenate([pairs, np.full((len(row), 1), _NEVER)], axis=1), place + (place >= i[:, None]), 1)
                pairs[k, i] = self._merges.of(ids[k, i], ids[k, i + 1])
                left = i > 0
                k, i = k[left], i[left]
                pairs[k, i - 1] = self._merges.of(ids[k, i - 1], ids[k, i])
            count = (done >= 0).sum(axis=1)
            cut = [0, *(np.cumsum(count) * 4).tolist()]
            numbers = done[done >= 0].astype("<u4").tobytes()
            for name, a, b in zip(names, cut, cut[1:], strict=False):
                out[name] = numbers[a:b]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self._pieces) > _KEPT:
            self._pieces = dict(itertools.islice(self._pieces.items(), _KEPT // 2))
        found: list[list[bytes | None]] = []
        gaps: list[tuple[list[bytes | None], list[str]]] = []
        for t in texts:
            if "<|" in t or not _PLAIN.fullmatch(t):
                found.append([np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            words = t.lower().split()
            ids = list(map(self._pieces.get, words))
            found.append(ids)
            if None in ids:
                gaps.append((ids, words))
        none = itertools.repeat(None)
        holes = [(ids, list(itertools.compress(range(len(ids)), map(operator.is_, ids, none))), words) for ids, words in gaps]
        pieces = self._pieces
        missing = {w for _, at, words in holes for w in map(words.__getitem__, at)}
        single = {w for w in missing if w.isalpha()}
        split = {w: (w[:-1], w[-1]) if w[-1] in ",." and w[:-1].isalpha() else _PART.findall(w) for w in missing - single}
        single.update(x for xs in split.values() for x in xs if x not in pieces)
        if single:
            pieces.update(self._encode_parts(list(single)))
        for w, xs in split.items():
            pieces[w] = b"".join([pieces[x] for x in xs])
        for ids, at, words in holes:
            for i in at:
                ids[i] = pieces[words[i]]
        return [b"".join(ids) for ids in found]


@functools.lru_cache(maxsize=1)
def shared_bpe(path: str) -> WordBpe:
    """One encoder for all tasks of a worker; its ids do not depend on what it has seen."""
    return WordBpe(path)
