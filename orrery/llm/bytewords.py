"""Words of UTF-8 texts and their hashes, vectorised over whole Arrow batches.

All word patterns used here are sets of ASCII bytes and everything above 0x7F,
so they can be found on the bytes of a text; positions count words. Texts are
worked on in stretches of 64 KB that end between words, so memory does not follow
the longest text. A stretch's arrays stay below ``resident.PAGED``: larger ones
have fresh pages each time, which took a third of the time of this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 16
_P = 0x9E3779B97F4A7C15 | 1
#: Hashes mixed at once.
_MIXED = 1 << 15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes between words, before folding: white space, or ASCII without letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[0x00:0x30] = PUNCT[0x3A:0x41] = PUNCT[0x5B:0x61] = PUNCT[0x7B:0x80] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; a bijection for any salt."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    if x.ndim != 1:
        return _mixed(x)
    for at in range(0, len(x), _MIXED):
        x[at : at + _MIXED] = _mixed(x[at : at + _MIXED])
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _P, np.uint64)
        down = np.full(size, pow(_P, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        keep = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n > STRETCH + (1 << 16):  # a single giant word; not worth keeping
            return keep
        _powers = keep
    return _powers


def _weighed(part: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Each byte plus one, times its power."""
    out = np.add(part, np.uint64(1), dtype=np.uint64)
    out *= up[: len(part)]
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes of the string column ``text``; a longer text is a part of its own."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < n:
            done = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def _stretches(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = 0, len(raw)
    while at < end:
        to = min(end, at + STRETCH)
        if to < end:
            k = np.searchsorted(offsets, to, "right") - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # within one long text: back to a separator, else on to the next
                gaps = np.flatnonzero(sep[raw[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    stop = int(offsets[k + 1])
                    while to < stop:
                        gaps = np.flatnonzero(sep[raw[to : to + STRETCH]])
                        if len(gaps) and to + int(gaps[0]) < stop:
                            to += int(gaps[0]) + 1
                            break
                        to = min(stop, to + STRETCH)
        yield at, to
        at = to


def words(texts: pa.Array, sep: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words in order, and for each text the place of its first word (n + 1 values)."""
    raw, offsets = buffers(texts)
    hashes, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    outside, folded = (~sep).tobytes(), fold.tobytes()
    for at, to in _stretches(raw, offsets, sep):
        part = raw[at:to]
        n, own = len(part), part.tobytes()
        inside = np.frombuffer(own.translate(outside), bool)
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        begin, end = np.empty(n + 1, bool), np.empty(n + 1, bool)
        begin[0], begin[n], end[0], end[n] = inside[0], False, False, inside[-1]
        np.greater(inside[1:], inside[:-1], out=begin[1:n])
        np.less(inside[1:], inside[:-1], out=end[1:n])
        begin[cuts], end[cuts] = inside[cuts], inside[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        up, down = _tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_weighed(np.frombuffer(own.translate(folded), np.uint8), up), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        firsts.append(s + at)
    h, s = np.concatenate(hashes), np.concatenate(firsts)
    return h, np.searchsorted(s, offsets, "left")


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within a text, and the place of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= np.uint64(_P)
        g += h[j : j + n]
    ok = np.ones(n, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return mix(g[at], k), at


def owner(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text that each word place belongs to."""
    return np.searchsorted(first, at, "right") - 1


def whole(h: np.ndarray, first: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """For texts ``which`` of exactly ``k`` words: the hash of the run of all their words, as ``grams`` has it."""
    g = np.zeros(len(which), np.uint64)
    for j in range(k):
        g = g * np.uint64(_P) + h[first[which] + j]
    return mix(g, k)
