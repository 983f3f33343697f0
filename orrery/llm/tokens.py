"""Token ids of whole texts with a tokenizers file, by a cache of space-separated pieces.

A text is cut at single spaces between two characters that are not white space.
No pre-tokenisation rule of the two public files joins what such a cut parts,
so ids of the pieces (each with its leading space) are the ids of the text;
texts with other white space around a space keep it within a piece. The pieces
of natural text repeat, and each is encoded once for a cache's life.

Cuts are found on the bytes of a whole batch, and pieces are looked up by a
64-bit hash of their bytes in an open table of numbers, so the cache holds no
strings and its memory is bounded by ``CACHE_PIECES``. Strings of special tokens
in a text are ordinary text, as the files' description has it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orrery.llm import bytewords as B
from orrery.llm.resident import only

CACHE_PIECES = 600_000
#: Unknown pieces encoded as one text, and such texts encoded at once: a tokenizer's results take far more room than their ids, and its time a piece grows with the text.
JOIN, AT_ONCE = 32, 64
#: Pieces that move at once when others are forgotten.
SHIFTED = 1 << 16
#: Pieces learned at once, and bytes of texts looked up at once: their arrays reuse a worker's pages (see ``resident``).
LEARNED, LOOKED_UP = 1 << 14, 1 << 18
#: Pieces of more bytes are encoded as they are, each as a text.
LONG = 256
#: Classes of bytes in a piece; digits, ' and other visible ASCII are ``VISIBLE``.
LETTER, MARK, LINE, VISIBLE, ELSE = 1, 2, 3, 4, 5
_class = np.full(256, ELSE, np.uint8)
_class[0x21:0x7F] = VISIBLE
_class[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_class[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = MARK
_class[0x0A] = LINE
#: A word and its marks, or two words with a line end between: both files part words from marks and line ends. Classes of
#: the runs of such a piece, three bits each.
_compound = np.zeros(1 << 15, bool)
for _runs in ((1, 2), (1, 3, 1), (1, 2, 3, 1), (1, 3, 1, 2), (1, 2, 3, 1, 2)):
    _compound[sum(x << 3 * i for i, x in enumerate(_runs))] = True

#: White space in ASCII, and the ends of white space beyond it by UTF-8 bytes.
_ascii_space = np.zeros(256, bool)
_ascii_space[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_two = np.zeros(256, bool)
_two[[0x85, 0xA0]] = True
_e280 = np.zeros(256, bool)
_e280[[*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True


def _wide_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are a white-space character."""
    return ((a == 0xE2) & (((b == 0x80) & _e280[c]) | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single spaces within a text between two characters that are not white space."""
    at = np.flatnonzero(raw == 0x20)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    at = at[~(edge[at] | edge[at + 1])]
    byte = lambda x: raw[np.clip(x, 0, len(raw) - 1)]
    before, after = raw[at - 1], raw[at + 1]
    ok = ~(_ascii_space[before] | _ascii_space[after])
    for i, beyond in ((0, np.flatnonzero(ok & (before >= 0x80))), (1, np.flatnonzero(ok & (after >= 0x80)))):
        x = at[beyond]
        a, b, c = (byte(x - 3), byte(x - 2), byte(x - 1)) if i == 0 else (byte(x + 1), byte(x + 2), byte(x + 3))
        two = (b == 0xC2) & _two[c] if i == 0 else (a == 0xC2) & _two[b]
        ok[beyond[two | _wide_space(a, b, c)]] = False
    return at[ok]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] values, then the next."""
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each piece, raw[start:end], and of whether it is its text's first; never 0. Pieces ascend."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + B.STRETCH, "right")))
        part = raw[base : int(ends[to - 1])]
        up, down = B._tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return np.maximum(B.mix(out + first.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 17), np.uint64(1))


class Places:
    """An open table from hashes to places; hashes are mixed already and not 0."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << max(12, (3 * most // 2).bit_length())) - 1)  # at most two thirds are held
        self.key = np.zeros(int(self.mask) + 1, np.uint64)
        self.place = np.zeros(int(self.mask) + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(keys), -1, np.int64)
        which, slot = np.arange(len(keys)), keys & self.mask
        while len(which):
            held = self.key[slot]
            hit = held == keys[which]
            out[which[hit]] = self.place[slot[hit]]
            on = ~hit & (held != 0)
            which, slot = which[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def clear(self) -> None:
        self.key[:] = 0

    def add(self, keys: np.ndarray, first: int) -> None:
        """Distinct hashes that are not held, at places ``first``, ``first`` + 1, ..."""
        which, slot = np.arange(len(keys)), keys & self.mask
        while len(which):
            free = self.key[slot] == 0
            self.key[slot[free]] = keys[which[free]]  # of several for a slot, the last stays
            won = self.key[slot] == keys[which]
            self.place[slot[won]] = first + which[won]
            which, slot = which[~won], (slot[~won] + np.uint64(1)) & self.mask


def _plain(piece: str) -> bool:
    """Whether a piece, less its leading space, is letters or visible characters, and so may be parted from others by white space."""
    return piece.isalpha() or bool(piece) and " " not in piece and piece.isprintable()


def _classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of pieces."""
    out = _class[raw]
    lead = np.flatnonzero(raw == 0xC3)  # of Latin letters, but for two signs
    lead = lead[(lead + 1 < len(raw))]
    after = raw[lead + 1]
    lead = lead[(after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: bytes, sep: bytes) -> list[str]:
    """Texts of ``JOIN`` pieces each, with ``before`` before every piece and ``sep`` between them."""
    size = ends - starts
    each = size + len(before) + len(sep)
    to = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.uint8)
    out[_ranges(to + len(before), size)] = raw[_ranges(starts, size)]
    for i, x in enumerate(before):
        out[to + i] = x
    for i, x in enumerate(sep):
        out[to + len(before) + size + i] = x
    own, cuts = out.tobytes(), [*to[::JOIN].tolist(), len(out)]
    return [own[a : b - len(sep)].decode() for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Ids by text for one tokenizers file; lives as long as the Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # the pieces are kept here
        self.parted = self._separator()
        self._clear(1 << 14)

    def _clear(self, room: int) -> None:
        self.places = Places(room)
        self.room, self.n, self.used = room, 0, 0
        self.keys = np.zeros(room, np.uint64)
        self.size, self.begin, self.hits = (np.zeros(room, np.int32) for _ in range(3))
        self.flat = np.zeros(1 << 14, np.uint32)

    def _resize(self, room: int) -> None:
        """Room for as many pieces; those held stay."""
        n, self.room = self.n, room
        fit = lambda x: np.concatenate([x[:n], np.zeros(room - n, x.dtype)])
        self.places = None  # goes before its successor is made
        self.keys, self.size, self.begin, self.hits = fit(self.keys), fit(self.size), fit(self.begin), fit(self.hits)
        self.places = Places(room)
        self.places.add(self.keys[:n], 0)

    def _add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        n, m = self.n, self.n + len(keys)
        if m > self.room:
            self._resize(max(m, 2 * self.room))
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(self.used + len(flat), 2 * len(self.flat)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.places.add(keys, n)
        self.keys[n:m], self.size[n:m], self.begin[n:m] = keys, size, self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = m, self.used + len(flat)

    def _shrink(self) -> None:
        """Forgets pieces that were met once; if many are left, all but those met most. Tables are used again, not copied."""
        hits = self.hits[: self.n]
        least = max(2, int(np.partition(hits, -CACHE_PIECES // 2)[-CACHE_PIECES // 2]) + 1)
        keep = np.flatnonzero(hits >= least)
        used = 0
        for i in range(0, len(keep), SHIFTED):  # in place, as what is kept only moves down
            at = keep[i : i + SHIFTED]
            size, flat = self.size[at], self.flat[_ranges(self.begin[at].astype(np.int64), self.size[at])]
            self.keys[i : i + len(at)], self.size[i : i + len(at)] = self.keys[at], size
            self.begin[i : i + len(at)] = used + np.cumsum(size) - size
            self.flat[used : used + len(flat)] = flat
            used += len(flat)
        self.n, self.used = len(keep), used
        hits[:] = 0
        if self.room > 2 * CACHE_PIECES or len(self.flat) > 8 * CACHE_PIECES:  # one text was very long
            self.flat = self.flat[: max(used, 1 << 14)].copy()
            self._resize(CACHE_PIECES)
        else:
            self.places.clear()
            self.places.add(self.keys[: self.n], 0)

    def _separator(self) -> tuple[str, int] | None:
        """A string that parts pieces in one text and its id, if the tokenizer has one."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for sep in ("\n", " \x01 "):
            own = ids(sep)
            if len(own) == 1 and all(ids(a + sep + b) == [*ids(a), own[0], *ids(b)] and own[0] not in ids(a + b) for a in (" a", "b", ".", " ,", "1", "\u00e9", " '", "'s") for b in (" a", "b", ".", " ,", "1", "\u00e9", " '", "'s")):
                return sep, own[0]
        return None

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keys: np.ndarray) -> None:
        """Adds pieces, raw[start:end], of distinct hashes; words and marks of compound ones are encoded apart, and once each."""
        left = np.flatnonzero(self.places.find(keys) < 0)  # some came as parts of others
        starts, ends, first, keys = starts[left], ends[left], first[left], keys[left]
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            self._add_each([raw[a:b].tobytes().decode() for a, b in zip(starts[long].tolist(), ends[long].tolist())], first[long], keys[long])
            short = np.flatnonzero(ends - starts <= LONG)
            starts, ends, first, keys = starts[short], ends[short], first[short], keys[short]
        if not len(keys):
            return
        size = ends - starts
        raw = raw[_ranges(starts, size)]
        ends = np.cumsum(size)
        starts = ends - size
        kind = _classes(raw)
        if not self.parted:
            return self._encode_new(raw, starts, ends, first, keys, kind)
        new = np.ones(len(raw), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        run = np.flatnonzero(new)
        of = kind[run].astype(np.int64)
        of[(of == LINE) & (np.diff(run, append=len(raw)) > 1)] = ELSE
        at = np.searchsorted(run, starts)
        many = np.diff(at, append=len(run))
        code = np.zeros(len(at), np.int64)
        for i in range(5):
            code += np.where(many > i, of[np.minimum(at + i, len(of) - 1)], 0) << 3 * i
        made = _compound[code] & (many <= 5) & ~first
        if not made.any():
            return self._encode_new(raw, starts, ends, first, keys, kind)
        # a line end goes with the marks before it
        runs = _ranges(at[made], many[made])
        head = np.zeros(len(run), bool)
        head[at[made]] = True
        runs = runs[(of[runs] != LINE) | (of[runs - 1] != MARK)]
        begin, lead = run[runs], head[runs]
        owner = np.cumsum(lead) - 1
        end = np.append(begin[1:], 0)
        last = np.append(lead[1:], True)
        end[last] = ends[made]
        parts = hashes(raw, begin, end, ~lead)
        _, one = np.unique(parts, return_index=True)
        one = one[self.places.find(parts[one]) < 0]
        rest = np.flatnonzero(~made)
        both = [np.concatenate(x) for x in ((starts[rest], begin[one]), (ends[rest], end[one]), (first[rest], ~lead[one]), (keys[rest], parts[one]))]
        _, some = np.unique(both[3], return_index=True)
        if len(some):
            self._encode_new(raw, *(x[some] for x in both), kind)
        at = self.places.find(parts)
        n = self.size[at].astype(np.int64)
        self._add(keys[made], np.bincount(owner, n).astype(np.int64), self.flat[_ranges(self.begin[at].astype(np.int64), n)])

    def _encode_new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keys: np.ndarray, kind: np.ndarray) -> None:
        """Many pieces are encoded as one text, parted by a token that none of them holds."""
        apart = np.zeros(len(keys), bool)
        if self.parted:
            odd = np.concatenate([[0], np.cumsum((kind == ELSE) | (kind == LINE))])
            apart = odd[ends] == odd[starts]  # letters and visible ASCII
            for i in np.flatnonzero(~apart).tolist():
                apart[i] = _plain(raw[starts[i] : ends[i]].tobytes().decode())
        rest = np.flatnonzero(~apart)
        if len(rest):
            self._add_each([raw[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())], first[rest], keys[rest])
        for some, before in ((np.flatnonzero(apart & ~first), b" "), (np.flatnonzero(apart & first), b"")):
            if not len(some):
                continue
            sep, mark = self.parted
            got = list(self._ids(_joined(raw, starts[some], ends[some], before, sep.encode())))
            ids = np.insert(np.concatenate(got), np.cumsum([len(x) for x in got]), mark)
            at = np.flatnonzero(ids == mark)
            if len(at) != len(some):
                raise ValueError("a piece holds the separator")
            self._add(keys[some], np.diff(at, prepend=-1) - 1, np.delete(ids, at))

    def _add_each(self, pieces: list[str], first: np.ndarray, keys: np.ndarray) -> None:
        """Pieces that are a text each."""
        got = list(self._ids([x if f else " " + x for x, f in zip(pieces, first.tolist())], 200))
        self._add(keys, np.fromiter(map(len, got), np.int64, len(got)), np.concatenate(got))

    def _ids(self, texts: list[str], at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), at_once):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.array(x.ids, np.uint32)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (n + 1 values)."""
        raw, offsets = B.buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        found, sizes, at = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + LOOKED_UP, "right")) - 1)
            ids, size = self._encoded(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            found.append(ids)
            sizes.append(size)
            at = to
        return np.concatenate(found), np.cumsum(np.concatenate(sizes))

    def _encoded(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each has."""
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        at = cuts(raw, offsets)
        counts = np.zeros(len(offsets) - 1, np.int64)
        counts[some] = 1 + np.searchsorted(at, offsets[some + 1]) - np.searchsorted(at, offsets[some])
        begins = (np.cumsum(counts) - counts)[some]
        starts = np.insert(at + 1, np.searchsorted(at, offsets[some]), offsets[some])
        ends = np.insert(at, np.searchsorted(at, offsets[some + 1]), offsets[some + 1])
        first = np.zeros(len(starts), bool)
        first[begins] = True
        if self.n > CACHE_PIECES:
            self._shrink()
        keys = hashes(raw, starts, ends, first)
        at = self.places.find(keys)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            _, one, same = np.unique(keys[missed], return_index=True, return_inverse=True)
            new = missed[one]
            for i in range(0, len(new), LEARNED):
                k = new[i : i + LEARNED]
                self._learn(raw, starts[k], ends[k], first[k], keys[k])
            at[missed] = self.places.find(keys[new])[same]
        np.add.at(self.hits, at, np.int32(1))
        n = self.size[at].astype(np.int64)
        ids = self.flat[_ranges(self.begin[at].astype(np.int64), n)]
        piece_ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(piece_ends[np.concatenate([[0], np.cumsum(counts)])])


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it is let go when another operator's task runs in the worker."""
    return only(path, lambda: Encoder(path))


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    n = len(begin) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = begin[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends], out[mask] = end_id, ids
    return out, begin + np.arange(n + 1)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
