"""Word and shingle hashes of whole Arrow batches, computed on the UTF-8 buffers.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z
lower-cased. All other bytes stay, so the words equal those of the pattern
[^\\x20\\x09-\\x0D]+ over the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _mix((_LOWER + 1).astype(U) * U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = _SPACE.copy()
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_R, _Q1, _Q2 = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows; null is an empty text. No text is split."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(off)
    if column.null_count:
        length = np.where(column.is_valid().to_numpy(zero_copy_only=False), length, 0)
    at = 0
    while at < n:
        to = at + max(1, int(np.searchsorted(np.cumsum(length[at : at + 4096]), max_bytes, "right")))
        to = min(to, n)
        offsets = np.concatenate([[0], np.cumsum(length[at:to])])
        if offsets[-1] == off[to] - off[at]:
            part = raw[off[at] : off[to]]
        else:
            part = np.concatenate([raw[off[i] : off[i] + length[i]] for i in range(at, to)])
        yield at, part, offsets
        at = to


def words(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the end)."""
    h, starts, _ = word_spans(part, offsets)
    return h, np.searchsorted(starts, offsets)


def word_spans(part: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, ends) of all words; with punctuation, ASCII punctuation separates words too."""
    n = len(part)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, U), e, e
    inside = ~(_PUNCTUATION if punctuation else _SPACE)[part]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    p, inv = _powers(_R, n)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[part] * p, dtype=U)])
    h = (total[ends] - total[starts]) * inv[starts]
    return _mix(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15)), starts, ends


_STEP = [U(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC6A4A7935BD1E995)]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, row ends not heeded; gram i starts at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += h[j : j + n] * _STEP[j]
    return _mix(out + U(k))


def shingle_sets(h: np.ndarray, rows: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Each row's sorted distinct k-word shingle hashes; with fewer words, the whole sequence as one."""
    grams = gram_hashes(h, k)
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield gram_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, U)


def sequence_keys(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's whole word sequence."""
    out = []
    n = len(h)
    for q, v in ((_Q1, h), (_Q2, _mix(h + U(1)))):
        p, inv = _powers(q, n + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(v * p[:n], dtype=U)])
        out.append(_mix((total[rows[1:]] - total[rows[:-1]]) * inv[rows[:-1]] + np.diff(rows).astype(U)).view(np.int64))
    return out[0], out[1]
