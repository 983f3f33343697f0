"""Language-model scoring by a hierarchical Pitman-Yor model.

Every previous word, and the begin of a text, is a context with a restaurant of
its own. All context restaurants share one parent, whose base is uniform over
the V known words and one outcome for all unseen ones, so an unseen word is less
likely than any known one.

The sampler alternates draws that are exact given what they condition on:

- The parent's distribution G0 given its seating: a gamma variate of (customers -
  discount * tables) for each word, and the new-table mass, spread by the base
  (at its mean), over their sum.
- For each context u a gamma variate g_u of shape strength / discount + tables.
  Given these and G0, the table counts of all (context, word) blocks are
  independent, with weights S(c, t) (discount g_u G0(w))^t, where S sums the
  weights of the seatings of c customers at t tables. So all blocks are drawn in
  parallel, and a sweep needs no counts of its own from the sweep before: only
  sums of tables by context and by word are kept.
- The parent's tables of each word likewise, given a gamma variate of the parent.

Blocks of one customer have one table. Blocks of up to 120 customers, and of few
tables, are drawn exactly, others by a normal law about the saddle point of the
weights, so cost does not grow with customers. Variates are functions of the word or pair and the
sweep, so a task that runs again draws the same.

Predictive probabilities are averaged over the kept sweeps, with the expected
tables of a block in place of drawn ones.

Counts of (context, word) pairs come from all training texts by a distributed
sum over the full vocabulary and stay in distributed tables, as do words. Tasks
hold the parameters of the most frequent words and the terms of the most
frequent pairs, both bounded. Every rare word has a share; pairs with one rare
word are dealt to its share, pairs of two to that of the context, and pairs of
frequent words by their hash. So a share has what its pairs need, but for the
words of pairs of two rare ones, which the words' shares send. All tables are
blocks of bytes, a share's rows of a kind each, so that Spark moves few rows and
joins none. Pairs are counted in two scans and scored in three, so that shuffles
take a share of the disk.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bytewords as B
from orrery.llm.resident import only
from orrery.llm.tables import table
from orrery.llm.tokens import Places
from orrery.session import dropped, written

#: Pairs whose terms, and words whose parameters, every task holds.
FREQUENT, WORDS = 1 << 19, 1 << 18
#: Parts in which pairs are scored, and bytes that a task is dealt of a part, at most about.
PASSES, DEALT = 3, 96 << 20
#: Scans of the texts in which pairs are counted.
COUNTS = 2
#: Shares, at most, that add up the sums of frequent words.
SPREAD = 256
BURN_IN, SWEEPS = 2, 4
DISCOUNT, STRENGTH = 0.75, 5.0
#: The hash that stands for the end of a text as a word, and for its begin as a context.
END = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once, so that arrays of its words stay below ``resident.PAGED``.
SLICE = 1 << 19
#: Distinct pairs a task holds before it passes counts on, and blocks it draws at once.
FLUSH, DRAWN = 1 << 20, 1 << 17
SMALL = 120


def log_seatings(n: int, discount: float) -> np.ndarray:
    """[c, t]: log of the summed weights of all seatings of c customers at t tables (generalised Stirling numbers)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(1, n + 1):
        stay = c - 1 - discount * t
        with np.errstate(invalid="ignore", divide="ignore"):
            out[c] = np.where(stay > 0, np.log(np.maximum(stay, 1e-300)) + out[c - 1], -np.inf)
            out[c, 1:] = np.logaddexp(out[c, 1:], out[c - 1, :-1])
        out[c, c + 1 :] = -np.inf
    return out


@cache
def _choose(n: int) -> np.ndarray:
    """[k - 1, t - 1]: ways to choose k of t."""
    return np.array([[float(math.comb(t, k)) for t in range(1, n + 1)] for k in range(1, n + 1)])


_weights: dict[float, np.ndarray] = {}


class Seats:
    """Tables t of blocks of ``c`` customers, with weights S(c, t) x^t: drawn, or their means.

    Blocks of few customers, and of few tables, are drawn exactly; those of many
    tables by a normal law about the saddle point.
    """

    GRID = 64
    #: Large blocks worked on at once.
    CHUNK = 4096

    def __init__(self, c: np.ndarray, discount: float = DISCOUNT, small: int = SMALL):
        self.d, self.n = discount, len(c)
        if discount not in _weights:
            _weights[discount] = log_seatings(SMALL, discount)
        c = c.astype(np.int64)
        order = np.argsort(np.minimum(c, small + 1).astype(np.int16), kind="stable")
        edges = np.searchsorted(c[order], np.arange(2, small + 2)) if self.n else np.zeros(small, np.int64)
        self.groups = [(x, order[a:b], _weights[discount][x, 1 : x + 1]) for x, a, b in zip(range(2, small + 1), edges[:-1].tolist(), edges[1:].tolist()) if b > a]
        self.large = np.flatnonzero(c > small)
        self.c = c[self.large].astype(float)
        kinds, self.kind = np.unique(self.c, return_inverse=True)
        self.grid = np.empty((len(kinds), self.GRID))
        for at in range(0, len(kinds), self.CHUNK):
            self.grid[at : at + self.CHUNK] = self._log_weights(kinds[at : at + self.CHUNK])

    def _phi(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At z of logit ``s``: phi, h = z phi' / phi, and z h'."""
        z, q = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(s))
        phi = -np.expm1(self.d * np.log(q)) / self.d
        h = z * q ** (self.d - 1) / phi
        return phi, h, h * (1 + z * (1 - self.d) / q - h)

    def _solve(self, n: int, above) -> np.ndarray:
        """The n logits where ``above`` turns true."""
        lo, hi = np.full(n, -60.0), np.full(n, 60.0)
        for _ in range(48):
            mid = (lo + hi) / 2
            up = above(mid)
            lo, hi = np.where(up, lo, mid), np.where(up, mid, hi)
        return (lo + hi) / 2

    def _log_weights(self, c: np.ndarray) -> np.ndarray:
        """[block, t - 1]: log of S(c, t) for t up to ``GRID``, but for what depends on c alone.

        S(c, t) = 1 / (t! d^t) sum over k of (-1)^k C(t, k) Gamma(c - d k) / Gamma(-d k);
        for c > ``SMALL`` terms fall fast enough to be summed as they are.
        """
        n = self.GRID
        k = np.arange(1, n + 1)
        choose = _choose(n)
        reciprocal = -np.sin(np.pi * self.d * k) / np.pi * np.exp([math.lgamma(self.d * j + 1) for j in k.tolist()])  # 1 / Gamma(-d k)
        x = c[:, None] - self.d * k[None, :]
        log_gamma = (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)
        ratio = np.exp(log_gamma - log_gamma[:, :1]) * reciprocal * np.where(k % 2 == 0, 1.0, -1.0)
        return np.log(np.maximum(ratio @ choose, 1e-300)) - k * math.log(self.d) - np.cumsum(np.log(k))

    def _mode(self, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance where weights of large t are greatest, by the saddle point of phi(z)^t.

        Near z = 1, where phi is singular, weights are those of a shifted Poisson
        law; its shift and the distance of its mean from its mode are 3 / 2.
        """
        s = self._solve(len(c), lambda s: x * self._phi(s)[0] * self._phi(s)[1] > c)
        phi, h, spread = self._phi(s)
        t = c / h
        return np.minimum(t + 1.5, c), t / (1 + h * h / np.maximum(spread, 1e-300))

    def _each(self, x: np.ndarray, small, large) -> np.ndarray:
        out = np.ones(self.n)
        lx = np.log(np.maximum(x, 1e-300))
        for c, which, weights in self.groups:
            step = max(1, (1 << 19) // c)
            for at in range(0, len(which), step):
                k = which[at : at + step]
                w = weights + lx[k, None] * np.arange(1, c + 1)
                out[k] = small(np.exp(w - w.max(axis=1, keepdims=True)), k)
        for at in range(0, len(self.large), self.CHUNK):
            k, c, grid = self.large[at : at + self.CHUNK], self.c[at : at + self.CHUNK], self.grid[self.kind[at : at + self.CHUNK]]
            w = grid + lx[k, None] * np.arange(1, self.GRID + 1)
            out[k] = large(np.exp(w - w.max(axis=1, keepdims=True)), k, c, *self._mode(c, np.maximum(x[k], 1e-300)))
        return out

    def draw(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Draws, by two uniform variates for each block."""

        def pick(w: np.ndarray, k: np.ndarray) -> np.ndarray:
            w = np.cumsum(w, axis=1)
            return 1.0 + (w < a[k, None] * w[:, -1:]).sum(axis=1)

        def large(w: np.ndarray, k: np.ndarray, c: np.ndarray, mode: np.ndarray, var: np.ndarray) -> np.ndarray:
            many = np.clip(np.round(mode + np.sqrt(-2 * var * np.log1p(-a[k])) * np.cos(2 * np.pi * b[k])), 1, c)
            return np.where(mode < 0.5 * self.GRID, pick(w, k), many)

        return self._each(x, pick, large)

    def mean(self, x: np.ndarray) -> np.ndarray:
        small = lambda w, k: (w * np.arange(1, w.shape[1] + 1)).sum(axis=1) / w.sum(axis=1)
        return self._each(x, small, lambda w, k, c, mode, var: np.where(mode < 0.5 * self.GRID, small(w, k), mode))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Variates in (0, 1) by hash."""
    return ((B.mix(key, salt) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def gammas(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variates by hash, by rejection (Marsaglia and Tsang); shapes below one by a power of a uniform."""
    shape = np.asarray(shape, float)
    a = np.where(shape < 1, shape + 1, shape)
    d = a - 1 / 3
    out, left, round_ = np.zeros(len(a)), np.arange(len(a)), 0
    while len(left):
        k = B.mix(key[left], salt * 64 + round_)
        u, v, w = (uniform(k, i) for i in (1, 2, 3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        c = 1 + x / np.sqrt(9 * d[left])
        with np.errstate(invalid="ignore", divide="ignore"):
            cube = c**3
            ok = (c > 0) & (np.log(w) < 0.5 * x * x + d[left] * (1 - cube + np.log(np.maximum(cube, 1e-300))))
        out[left[ok]] = d[left[ok]] * cube[ok]
        left, round_ = left[~ok], round_ + 1
    return np.where(shape < 1, out * uniform(B.mix(key, salt), 5) ** (1 / np.maximum(shape, 1e-3)), out)


@dataclass
class Root:
    """The parent after a sweep: sums over words, and the scalars drawn for the next."""

    tables: float
    customers: float
    mass: float
    outcomes: int
    rest: float = 0.0
    g: float = 0.0

    def drawn(self, rng: np.random.Generator) -> Root:
        self.rest = float(rng.gamma(STRENGTH + DISCOUNT * self.tables))
        self.g = float(rng.gamma(STRENGTH / DISCOUNT + self.tables))
        return self

    def g0(self, mass: np.ndarray) -> np.ndarray:
        """G0 of words with a gamma mass."""
        return (mass + self.rest / self.outcomes) / (self.mass + self.rest)

    def predictive(self, customers, tables):
        """Probability of a word by its customers and tables at the parent."""
        return (customers - DISCOUNT * tables + (STRENGTH + DISCOUNT * self.tables) / self.outcomes) / (STRENGTH + self.customers)


def root_step(key: np.ndarray, customers: np.ndarray, tables_u: np.ndarray, g: float, outcomes: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words: tables at the parent, gamma masses, and as contexts g_u."""
    t0 = np.where(customers > 0, Seats(customers).draw(np.full(len(key), DISCOUNT * g / outcomes), uniform(key, salt), uniform(key, salt + 1)), 0.0)
    mass = np.where(customers > 0, gammas(np.maximum(customers - DISCOUNT * t0, 1e-3), key, salt + 2), 0.0)
    return t0, mass, gammas(STRENGTH / DISCOUNT + tables_u, key, salt + 3)


class Restaurants:
    """The same sampler in one task, for numbered contexts and words; word ``size`` - 1 may be the unseen one."""

    def __init__(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, size: int, seed: int = 0):
        self.u, self.w, self.c, self.size = u, w, c.astype(float), size
        self.rng = np.random.default_rng(seed)
        self.key = B.mix(np.arange(size, dtype=np.uint64), seed + 1)
        self.pair = B.mix(self.key[u], 1) + self.key[w]
        self.seats = Seats(self.c)
        self.sweeps = 0
        self.t = np.ceil(self.c**DISCOUNT)
        self._settle(float(size))

    def _settle(self, g: float) -> None:
        self.sweeps += 1
        self.tables = np.bincount(self.u, self.t, minlength=self.size)
        self.customers = np.bincount(self.w, self.t, minlength=self.size)
        self.t0, self.mass, self.g = root_step(self.key, self.customers, self.tables, g, self.size, 16 * self.sweeps)
        self.root = Root(self.t0.sum(), self.customers.sum(), self.mass.sum(), self.size).drawn(self.rng)

    def sweep(self) -> None:
        x = DISCOUNT * self.g[self.u] * self.root.g0(self.mass)[self.w]
        self.t = self.seats.draw(x, uniform(self.pair, 2 * self.sweeps), uniform(self.pair, 2 * self.sweeps + 1))
        self._settle(self.root.g)

    def predictive(self) -> np.ndarray:
        """(contexts, words) probabilities."""
        total = STRENGTH + np.bincount(self.u, self.c, minlength=self.size)
        out = ((STRENGTH + DISCOUNT * self.tables) / total)[:, None] * self.root.predictive(self.customers, self.t0)[None, :]
        out[self.u, self.w] += (self.c - DISCOUNT * self.t) / total[self.u]
        return out


def averaged(u: np.ndarray, w: np.ndarray, c: np.ndarray, size: int, burn_in: int = BURN_IN, sweeps: int = SWEEPS, seed: int = 0) -> np.ndarray:
    """Predictive probabilities averaged over sweeps."""
    r = Restaurants(u, w, c, size, seed)
    total = np.zeros((size, size))
    for i in range(burn_in + sweeps):
        r.sweep()
        if i >= burn_in:
            total += r.predictive()
    return total / sweeps


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the place of each text's first token."""
    h, first = B.words(texts, B.SPACE)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return B.mix(B.mix(u, 1) + w, 2)


def _contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token."""
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[first[:-1]] = END
    return u


def _share(key: np.ndarray, shares: int) -> np.ndarray:
    key, n = key >> np.uint64(8), np.uint64(shares)
    return (key - key // n * n).astype(np.int32)  # numpy divides by a number faster than it takes the remainder


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes, and where each distinct one begins in it."""
    order = np.argsort(key)
    key = key[order]
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    return order, np.flatnonzero(begins)


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes in order and the sums of each column."""
    if not len(key):
        return key, *columns
    order, at = _runs(key)
    return key[order[at]], *(np.add.reduceat(c[order], at) for c in columns)


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each hash in ``keys``, which are in order, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


# Kinds of blocks and their columns. A table of blocks is ``(share, kind, data)``: the columns of some rows of a share
# as bytes one after another, so that Spark moves blocks, not rows.
WORD, COUNT, NONE, ONCE, MANY, NEAR, FAR, SUM, TOP, WANTED, RARE, PARAM, SCALAR, TOKEN, ROW, MODEL, ONES = range(17)
#: At this and the numbers after it: tables and customers of a share's rare words in a sweep.
STATE = 100
TYPES = {
    WORD: "u8 i8 i8",  # word, tokens in training texts, tokens
    COUNT: "u8 u8 i8",  # context, word, customers, as a task of texts counts them
    NONE: "u8 u8",  # pairs that only held-out texts have
    ONCE: "u8 u8",  # pairs of one customer
    MANY: "u8 u8 i8",  # and of more
    NEAR: "i4 i4 i8",  # those of two frequent words, by their places
    FAR: "u8 u8 i8",
    SUM: "u8 i8 i8",  # word, tables as context, tables as word
    TOP: "i4 i8 i8",  # the same of a frequent word
    WANTED: "u8 i4 u1",  # a rare word, a share that has pairs of it and another rare one, whether of several customers
    RARE: "u8 i8 i8 i8",  # word, customers, its pairs of one customer as context and as word
    PARAM: "u8 f8 f8",  # word, g, mass
    SCALAR: "f8 f8 f8",  # sums over rare words: tables at the parent, customers, mass
    TOKEN: "u8 i8",  # pair, row
    ROW: "i8 i4 i4 i8 f8 f8",  # row, rows, tokens, known tokens, base, total
    ONES: "u8",  # words of one customer
}
BLOCKS = "share int, kind int, data binary"


def _batch(shares: np.ndarray, kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shares, pa.int32()), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], ["share", "kind", "data"])


def _block(share: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return _batch(np.array([share]), kind, [b"".join(c.tobytes() for c in columns)])


def _dealt(to: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows as blocks for the shares ``to``."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")  # of 16 bits by radix
    to = to[order]
    at = np.flatnonzero(np.diff(to, prepend=-1))
    some, cuts = to[at], list(zip(at.tolist(), [*at[1:].tolist(), len(to)]))
    columns = [c[order] for c in columns]
    return _batch(some, kind, [b"".join(c[x:y].tobytes() for c in columns) for x, y in cuts])


def _undealt(data: list[bytes], types: str) -> list[np.ndarray]:
    """The columns of blocks."""
    kinds = [np.dtype(t) for t in types.split()]  # also of several values, as in (4,)f4
    size = sum(t.itemsize for t in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for x in data:
        n, at = len(x) // size, 0
        for t, col in zip(kinds, out):
            col.append(np.frombuffer(x, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, kinds)]


class Found(dict):
    """The blocks of a share by kind."""

    def take(self, kind: int, types: str = "") -> list[np.ndarray]:
        return _undealt(self.pop(kind, []), types or TYPES[kind])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Found]]:
    """A task's shares with all their blocks."""
    found: dict[int, Found] = {}
    for share, kind, data in _blocks(batches):
        found.setdefault(share, Found()).setdefault(kind, []).append(data)
    yield from found.items()


def _met(shares: int, run, *tables: DataFrame) -> DataFrame:
    """``run`` over the blocks of each share of several tables."""
    each = reduce(DataFrame.unionAll, tables).repartitionById(shares, F.col("share") % shares)
    return each.mapInArrow(run, BLOCKS)


def _shares(src: DataFrame, parts: int) -> int:
    """Shares of a part of the pairs of ``src`` (text)."""
    size = src.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    shares = max(src.sparkSession.sparkContext.defaultParallelism, math.ceil(4 * size / parts / DEALT))
    return COUNTS * math.ceil(shares / COUNTS)


class Top:
    """Columns of a bounded table, by hash."""

    def __init__(self, key: np.ndarray, columns: dict[str, np.ndarray]):
        self.key, self.columns = key, columns
        self.places = Places(max(1, 2 * len(key)))
        self.places.add(key, 0)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        slot = key & self.places.mask
        held = self.places.key[slot]
        out = np.where(held == key, self.places.place[slot], np.int32(-1))
        on = np.flatnonzero((out < 0) & (held != 0))
        out[on] = self.places.find(key[on])
        return out

    def has(self, key: np.ndarray) -> np.ndarray:
        held = self.places.key[key & self.places.mask]
        out = held == key
        on = np.flatnonzero(~out & (held != 0))
        out[on] = self.places.find(key[on]) >= 0
        return out


def _sent(spark: SparkSession, *tops: tuple[np.ndarray, dict[str, np.ndarray]]):
    """A broadcast of bounded tables, and how a task makes them a ``Top`` each."""
    sent, name = spark.sparkContext.broadcast(tops), uuid.uuid4().hex
    return sent, lambda: only(name, lambda: [Top(*x) for x in sent.value])


def _homes(t: Top | None, h: np.ndarray, first: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and share of each token: by the pair if both words are frequent, else by the rare word, the context if both are rare."""
    u = _contexts(h, first)
    home = u * _ODD + h
    if t is not None:
        rare = ~t.has(h)
        of_u = np.empty_like(rare)
        of_u[1:] = rare[:-1]
        of_u[first[:-1]] = ~t.has(np.array([END]))[0]
        some = np.flatnonzero(of_u)
        home[some] = u[some]
        some = np.flatnonzero(rare & ~of_u)
        home[some] = h[some]
    return u, _share(home, shares)


def word_counts(src: DataFrame, shares: int) -> DataFrame:
    """A block for each share of the words: tokens in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        held: list[tuple[np.ndarray, ...]] = []
        n = fresh = 0
        for batch in B.slices(batches, 0, size=SLICE):
            h, first = _tokens(batch.column(0))
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            for own, trained in ((h[train], 1), (h[~train], 0)):
                own, n_own = np.unique(own, return_counts=True)
                held.append((own, trained * n_own, n_own))
                fresh += len(own)
            if fresh > n + FLUSH:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                n = fresh = len(held[0][0])
                if n > FLUSH:
                    yield out(held.pop())
                    n = fresh = 0
        if held:
            yield out(_summed(*map(np.concatenate, zip(*held))))

    def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return _dealt(_share(x[0], shares), WORD, *x)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        for share, found in _gather(batches):
            yield _block(share, WORD, *_summed(*found.take(WORD)))

    return _met(shares, total, src.select("text", "held_out").mapInArrow(run, BLOCKS))


def pair_blocks(src: DataFrame, part: int, parts: int, shares: int, top=None) -> DataFrame:
    """The pairs of a part with their customers from training texts, as blocks ``NONE``, ``ONCE`` and ``MANY`` of its shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0] if top else only("pitman_yor")
        held: list[tuple[np.ndarray, ...]] = []
        n = fresh = 0
        for batch in B.slices(batches, 0, size=SLICE):
            h, first = _tokens(batch.column(0))
            u, to = _homes(t, h, first, parts * shares)
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            mine = np.flatnonzero((to >= part * shares) & (to < (part + 1) * shares))
            u, h = u[mine], h[mine]
            held.append((_pair(u, h), u, h, to[mine], train[mine].astype(np.int64)))
            fresh += len(mine)
            if fresh > n + FLUSH // 2:
                held = [counts(held)]
                n = fresh = len(held[0][0])
                if n > FLUSH // 2:
                    yield out(*held.pop())
                    n = fresh = 0
        if held:
            yield out(*counts(held))

    def counts(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        k, u, w, to, c = map(np.concatenate, zip(*held))
        if not len(k):
            return k, u, w, to, c
        order, at = _runs(k)
        some = order[at]
        return k[some], u[some], w[some], to[some], np.add.reduceat(c[order], at)

    def out(k: np.ndarray, u: np.ndarray, w: np.ndarray, to: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return _dealt(to, COUNT, u, w, c)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        for share, found in _gather(batches):
            u, w, c = found.take(COUNT)
            _, u, w, _, c = counts([(_pair(u, w), u, w, u, c)])
            for kind, x in ((NONE, c == 0), (ONCE, c == 1), (MANY, c > 1)):
                yield _block(share, kind, u[x], w[x], *([c[x]] if kind == MANY else []))

    return _met(shares, total, src.select("text", "held_out").mapInArrow(run, BLOCKS))


def _customers(kind: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, w, *c = columns
    return u, w, c[0] if c else np.full(len(u), int(kind == ONCE))


def pair_counts(src: DataFrame, part: int, parts: int, shares: int) -> DataFrame:
    """``(u, w, c)``: customers from training texts of every (context, word) pair of a part; 0 where only held-out texts have it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, data in _blocks(batches):
            u, w, c = _customers(kind, _undealt([data], TYPES[kind]))
            yield from pa.table([pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], names=["u", "w", "c"]).to_batches(DRAWN)

    return pair_blocks(src, part, parts, shares).mapInArrow(rows, "u long, w long, c long")


def _step(count: np.ndarray) -> np.ndarray:
    """A step of a fine scale for each count, so that the largest are found without a sort."""
    return np.floor(np.log2(np.maximum(count, 1)) * 64).astype(np.int32)


def _least(steps: DataFrame, most: int) -> int:
    """The step from which on there are at most ``most`` of ``steps`` (s, n)."""
    least, n = 1 << 30, 0
    for s, x in sorted(((r["s"], r["n"]) for r in steps.groupBy("s").agg(F.sum("n").alias("n")).collect()), reverse=True):  # at most 64 * 63 rows
        n += x
        if n > most:
            break
        least = s
    return least


def _steps(df: DataFrame, kind: int, column: int) -> DataFrame:
    """``(s, n)``: how many rows of the blocks of a kind are at each step of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _blocks(batches):
            s, n = np.unique(_step(_undealt([data], TYPES[kind])[column]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n.astype(np.int64))], ["s", "n"])

    return df.where(F.col("kind") == kind).mapInArrow(run, "s int, n long")


def _top_sums(tu: np.ndarray, tw: np.ndarray, shares: int) -> pa.RecordBatch:
    some = np.flatnonzero((tu > 0) | (tw > 0)).astype(np.int32)
    return _dealt(some % min(shares, SPREAD), TOP, some, tu[some], tw[some])


def _met_top(found: Found) -> tuple[np.ndarray, ...]:
    return _summed(*found.take(TOP))


def _rare_sums(u: np.ndarray, w: np.ndarray, n: np.ndarray, iu: np.ndarray, iw: np.ndarray, shares: int) -> pa.RecordBatch:
    """Sums by rare contexts and words, for the shares of these."""
    a, b = iu < 0, iw < 0
    n = n.astype(np.int64)
    key, tu, tw = _summed(np.concatenate([u[a], w[b]]), np.concatenate([n[a], np.zeros(b.sum(), np.int64)]), np.concatenate([np.zeros(a.sum(), np.int64), n[b]]))
    return _dealt(_share(key, shares), SUM, key, tu, tw)


def _add(sums: np.ndarray, places: np.ndarray, n: np.ndarray) -> None:
    ok = places >= 0
    sums += np.bincount(places[ok], n[ok], minlength=len(sums)).astype(np.int64)


def _once(pairs: DataFrame, top, shares: int) -> DataFrame:
    """Sums of pairs of one customer, and which rare words the shares of other rare words want."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        tu, tw = np.zeros(len(t.key), np.int64), np.zeros(len(t.key), np.int64)
        for share, kind, data in _blocks(batches):
            u, w, c = _customers(kind, _undealt([data], TYPES[kind]))
            iu, iw = t.find(u), t.find(w)
            if kind == ONCE:
                _add(tu, iu, c)
                _add(tw, iw, c)
                yield _rare_sums(u, w, c, iu, iw, shares)
            key = np.unique(w[(iu < 0) & (iw < 0)])
            to = _share(key, shares)
            key, to = key[to != share], to[to != share]
            yield _dealt(to, WANTED, key, np.full(len(key), share, np.int32), np.full(len(key), kind == MANY, np.uint8))
        yield _top_sums(tu, tw, shares)

    return pairs.mapInArrow(run, BLOCKS)


def _rare(words: DataFrame, once: DataFrame, top, shares: int) -> DataFrame:
    """The rare words of each share with their counts, what other shares want of them, and sums of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        for share, found in _gather(batches):
            key, cw, _ = found.take(WORD)
            rare = (cw > 0) & (t.find(key) < 0)
            key, cw = key[rare], cw[rare]
            k, tu, tw = _summed(*found.take(SUM))
            su, sw = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            at = _find(key, k)
            su[at], sw[at] = tu, tw
            yield _block(share, RARE, key, cw, su, sw)
            w, to, many = found.take(WANTED)
            if len(w):
                order, at = _runs(_pair(w, to.astype(np.uint64)))
                some = order[at]
                yield _block(share, WANTED, w[some], to[some], np.maximum.reduceat(many[order], at))
            yield _block(share, TOP, *_met_top(found))

    return _met(shares, run, words, once)


def _near_and_far(pairs: DataFrame, top) -> DataFrame:
    """Pairs of several customers: of frequent words by their places, and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        for share, _, data in _blocks(batches):
            u, w, c = _undealt([data], TYPES[MANY])
            iu, iw = t.find(u), t.find(w)
            near = (iu >= 0) & (iw >= 0)
            yield _block(share, NEAR, iu[near].astype(np.int32), iw[near].astype(np.int32), c[near])
            yield _block(share, FAR, u[~near], w[~near], c[~near])

    return pairs.where(F.col("kind") == MANY).mapInArrow(run, BLOCKS)


def _cuts(n: int) -> Iterator[slice]:
    return (slice(at, at + DRAWN) for at in range(0, n, DRAWN))


def _tables(many: DataFrame, params: DataFrame | None, top, root: Root | None, sweep: int, shares: int) -> DataFrame:
    """Sums of the tables drawn in a sweep by context and by word. Without ``params`` the first guess."""

    def drawn(u: np.ndarray, w: np.ndarray, c: np.ndarray, g: np.ndarray, mass: np.ndarray) -> np.ndarray:
        k = _pair(u, w)
        again, large = np.zeros(len(k)), np.flatnonzero(c > SMALL)  # only large blocks need a second variate
        again[large] = uniform(k[large], 2 * sweep + 101)
        return Seats(c).draw(DISCOUNT * g * root.g0(mass), uniform(k, 2 * sweep + 100), again).astype(np.int64)

    guess = lambda c: np.ceil(c.astype(float) ** DISCOUNT).astype(np.int64)

    def of_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        tu, tw = np.zeros(len(t.key), np.int64), np.zeros(len(t.key), np.int64)
        for _, _, data in _blocks(batches):
            iu, iw, c = _undealt([data], TYPES[NEAR])
            for x in _cuts(len(c)):
                u, w = iu[x], iw[x]
                n = drawn(t.key[u], t.key[w], c[x], t.columns["g"][u], t.columns["mass"][w]) if root else guess(c[x])
                _add(tu, u, n)
                _add(tw, w, n)
        yield _top_sums(tu, tw, shares)

    def of_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        tu, tw = np.zeros(len(t.key), np.int64), np.zeros(len(t.key), np.int64)
        for _, found in _gather(batches):
            us, ws, cs = found.take(FAR)
            key, g, mass = found.take(PARAM)
            order = np.argsort(key)
            key, g, mass = key[order], g[order], mass[order]
            for x in _cuts(len(cs)):
                u, w, c = us[x], ws[x], cs[x]
                iu, iw = t.find(u), t.find(w)
                if root:
                    of = lambda i, k, top, rare: np.where(i >= 0, top[i] if len(top) else 0.0, rare[_find(key, k)] if len(rare) else 0.0)  # noqa: B023, E731
                    n = drawn(u, w, c, of(iu, u, t.columns["g"], g), of(iw, w, t.columns["mass"], mass))
                else:
                    n = guess(c)
                _add(tu, iu, n)
                _add(tw, iw, n)
                yield _rare_sums(u, w, n, iu, iw, shares)
        yield _top_sums(tu, tw, shares)

    far = many.where(F.col("kind") == FAR)
    far = far.mapInArrow(of_far, BLOCKS) if params is None else _met(shares, of_far, far, params.where(F.col("kind") == PARAM))
    return many.where(F.col("kind") == NEAR).mapInArrow(of_near, BLOCKS).unionAll(far)


def _params(rare: DataFrame, tables: DataFrame, g: float, outcomes: int, sweep: int, shares: int) -> DataFrame:
    """Of each share: tables and customers of its rare words, their variates of the next sweep, their sums, and tables of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        for share, found in _gather(batches):
            key, cw, su, sw = found.take(RARE)
            k, tu, tw = _summed(*found.take(SUM))
            at = _find(key, k)
            su[at] += tu
            sw[at] += tw
            yield _block(share, STATE, su, sw)
            # words of one customer have one table everywhere
            many = cw > 1
            act, one = key[many], key[~many]
            t0, mass, gu = root_step(act, sw[many], su[many], g, outcomes, _salt(sweep))
            rest = gammas(np.full(len(one), 1 - DISCOUNT), one, _salt(sweep) + 2)
            yield _block(share, SCALAR, np.array([t0.sum() + len(one)]), np.array([float(sw.sum())]), np.array([mass.sum() + rest.sum()]))
            yield _block(share, PARAM, act, gu, mass)
            w, to, several = found.take(WANTED)
            at = _find(act, w)
            ok = (at >= 0) & (several > 0)
            yield _dealt(to[ok], PARAM, w[ok], gu[at[ok]], mass[at[ok]])
            yield _block(share, TOP, *_met_top(found))

    return _met(shares, run, rare.where(F.col("kind") != TOP), tables)


def _salt(sweep: int) -> int:
    return 16 * sweep + 7


def _collected(df: DataFrame, *kinds: int) -> Found:
    """Blocks of bounded kinds on the driver, in order of their shares."""
    found = Found()
    for r in sorted(df.where(F.col("kind").isin(*kinds)).collect(), key=lambda r: r["share"]):
        found.setdefault(r["kind"], []).append(bytes(r["data"]))
    return found


def _placed(found: Found, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of frequent words by place."""
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, tu, tw = found.take(TOP)
    a[at], b[at] = tu, tw
    return a, b


@dataclass
class Model:
    """Counts of pairs, the frequent words with their terms, rare ones with theirs in blocks by share, and sums."""

    pairs: list[DataFrame]
    many: DataFrame
    shares: int
    key: np.ndarray
    top: dict[str, np.ndarray]
    rare: DataFrame
    tokens: int
    known: int
    #: New-table probability of the unseen word, and of a word of one customer, in each kept sweep.
    unseen: list[float]
    ones: list[float]


def train(src: DataFrame, burn_in: int = BURN_IN, sweeps: int = SWEEPS, seed: int = 0) -> Model:
    """Counts the pairs of ``src`` (text, held_out) and samples the seating of its training texts."""
    spark = src.sparkSession
    shares = _shares(src, PASSES)
    n_shares = PASSES * shares
    words = written(word_counts(src, n_shares), "words")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _blocks(batches):
            _, cw, _ = _undealt([data], TYPES[WORD])
            yield pa.RecordBatch.from_arrays([pa.array([int(cw.sum())]), pa.array([int((cw > 0).sum())])], ["tokens", "known"])

    n_all, v_all = words.mapInArrow(sizes, "tokens long, known long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    outcomes = int(v_all) + 1
    # by all tokens, so that no word of held-out texts alone is dealt as a rare one if there are very many of it
    least = _least(_steps(words, WORD, 2), WORDS)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _blocks(batches):
            key, cw, every = _undealt([data], TYPES[WORD])
            some = _step(every) >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(cw[some])], ["key", "cw"])

    got = words.mapInArrow(frequent, "key long, cw long").toArrow()
    key, cw = got["key"].to_numpy().astype(np.int64).view(np.uint64), got["cw"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    key, cw = key[order], cw[order]
    sent, top = _sent(spark, (key, {}))

    pairs = [written(pair_blocks(src, p, COUNTS, n_shares // COUNTS, top), f"pairs{p}") for p in range(COUNTS)]
    every = reduce(DataFrame.unionAll, pairs)
    many = written(_near_and_far(every, top), "many")
    rare = written(_rare(words, _once(every, top, n_shares), top, n_shares), "rare")
    dropped(words)
    su, sw = _placed(_collected(rare, TOP), len(key))

    rng = np.random.default_rng(seed)
    params, root, state, kept, states, roots = None, None, None, [], [], []
    for i in range(-1, burn_in + sweeps):
        sweep, g = i + 1 + 1000 * seed, root.g if root else float(outcomes)
        now = written(_params(rare, _tables(many, params, top, root, sweep, n_shares), g, outcomes, sweep, n_shares), "params")
        found = _collected(now, TOP, SCALAR)
        tu, tw = _placed(found, len(key))
        tables, customers = su + tu, sw + tw
        t0, mass, gu = root_step(key, customers, tables, g, outcomes, _salt(sweep))
        s = [x.sum() for x in found.take(SCALAR)]
        new = Root(t0.sum() + s[0], customers.sum() + s[1], mass.sum() + s[2], outcomes).drawn(rng)
        if i >= burn_in:
            # g and mass are those the sweep's tables were drawn with; tables and customers what came of them
            kept.append({"g": DISCOUNT * state[1], "q": root.g0(state[0]), "back": STRENGTH + DISCOUNT * tables, "p": new.predictive(customers, t0)})
        if params is not None and i < burn_in:
            dropped(params)
        if i >= burn_in - 1:
            states.append((now, g, sweep))
            roots.append(new)
        params, root, state = now, new, (mass, gu)
        sent.destroy()
        sent, top = _sent(spark, (key, {"g": gu, "mass": mass}))
    sent.destroy()

    columns = {c: np.stack([x[c] for x in kept], 1).astype(np.float32) for c in ("g", "q", "back", "p")} | {"cw": cw, "size": cw + STRENGTH}
    model = written(_terms_of_rare(rare, states, roots, outcomes, n_shares), "model")
    dropped(rare, *(x[0] for x in states))
    return Model(pairs, many, shares, key, columns, model, int(n_all), int(v_all), [float(r.predictive(0.0, 0.0)) for r in roots[1:]], [float(r.predictive(1.0, 1.0)) for r in roots[1:]])


def _terms_of_rare(rare: DataFrame, states: list[tuple[DataFrame, float, int]], roots: list[Root], outcomes: int, shares: int) -> DataFrame:
    """Terms of the kept sweeps of rare words, for their shares and those that want them; ``states`` begin before the first kept sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        for share, found in _gather(batches):
            key, cw, _, _ = found.take(RARE)
            many = cw > 1
            act, one, cw = key[many], key[~many], cw[many]
            out: dict[str, list[np.ndarray]] = {"g": [], "q": [], "back": [], "p": []}
            for i, (g, sweep) in enumerate(drawn):
                tables, customers = (x[many] for x in found.take(STATE + i, "i8 i8"))
                t0, mass, gu = root_step(act, customers, tables, g, outcomes, _salt(sweep))
                if i:
                    out["back"].append(STRENGTH + DISCOUNT * tables)
                    out["p"].append(roots[i].predictive(customers, t0))
                if i + 1 < len(drawn):
                    out["g"].append(DISCOUNT * gu)
                    out["q"].append(roots[i].g0(mass))
            terms = [np.stack(out[c], 1).astype(np.float32) for c in ("g", "q", "back", "p")]
            yield _block(share, MODEL, act, cw, *terms)
            yield _block(share, ONES, one)
            w, to, _ = found.take(WANTED)
            at = _find(act, w)
            ok = at >= 0
            yield _dealt(to[ok], MODEL, w[ok], cw[at[ok]], *(x[at[ok]] for x in terms))
            ok = _find(one, w) >= 0
            yield _dealt(to[ok], ONES, w[ok])

    drawn = [(g, sweep) for _, g, sweep in states]
    each = [df.where(F.col("kind") == STATE).withColumn("kind", F.lit(STATE + i)) for i, (df, _, _) in enumerate(states)]
    return _met(shares, run, rare.where(F.col("kind") != TOP), *each)


def chances(c: np.ndarray, size: np.ndarray, g: np.ndarray | None, q: np.ndarray | None, back: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the averaged probability of pairs of ``c`` customers; without ``g`` and ``q`` of one or none."""
    total = np.einsum("ij,ij->i", back, p, dtype=float) / back.shape[1]
    if g is not None:
        seats = Seats(c)
        total += c - DISCOUNT * sum(seats.mean(g[:, i].astype(float) * q[:, i]) for i in range(g.shape[1])) / g.shape[1]
    else:
        total[c == 1] += 1 - DISCOUNT
    return np.log10(total / size)


class Terms:
    """Terms of the words of a share: frequent ones, its rare ones, those of one customer, and all unseen ones."""

    def __init__(self, t: Top, unseen: list[float], ones: list[float], found: Found):
        self.t, self.k = t, len(unseen)
        key, cw, g, q, back, p = found.take(MODEL, "u8 i8" + f" ({self.k},)f4" * 4)
        order = np.argsort(key)
        self.key = key[order]
        self.one = np.sort(found.take(ONES)[0])
        zero = np.zeros((2, self.k))
        more = {"cw": [1, 0], "size": [1 + STRENGTH, STRENGTH], "g": zero, "q": zero, "back": zero + [[STRENGTH + DISCOUNT], [STRENGTH]], "p": np.array([ones, unseen])}
        own = {"cw": cw, "size": cw + STRENGTH, "g": g, "q": q, "back": back, "p": p}
        self.rare = {c: np.concatenate([own[c][order], np.asarray(more[c]).astype(t.columns[c].dtype)]) for c in own}

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each word: of frequent ones first."""
        at, n = self.t.find(x), len(self.t.key)
        left = np.flatnonzero(at < 0)
        x = x[left]
        place = _find(self.key, x)
        other = np.flatnonzero(place < 0)
        place[other] = len(self.key) + (_find(self.one, x[other]) < 0)
        at[left] = n + place
        return at

    def of(self, name: str, at: np.ndarray) -> np.ndarray:
        n, top = len(self.t.key), self.t.columns[name]
        rare = self.rare[name].take(np.maximum(at - n, 0), axis=0)
        if not n:
            return rare
        near = at < n
        return np.where(near[:, None] if rare.ndim > 1 else near, top.take(np.minimum(at, n - 1), axis=0), rare)

    def pairs(self, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words, and the terms of the pairs."""
        iu, iw = self.find(u), self.find(w)
        g, q = (self.of("g", iu), self.of("q", iw)) if len(c) and c.max() > 1 else (None, None)
        return self.of("cw", iw), chances(c, self.of("size", iu), g, q, self.of("back", iu), self.of("p", iw))


def _most(model: Model, top) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The most frequent pairs with their words' training counts and terms, in order."""
    least = _least(_steps(model.many, NEAR, 2), FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top()[0]
        of = t.columns
        for _, _, data in _blocks(batches):
            u, w, c = _undealt([data], TYPES[NEAR])
            some = _step(c) >= least
            u, w, c = u[some], w[some], c[some]
            for x in _cuts(len(c)):
                lp = chances(c[x], of["size"][u[x]], of["g"][u[x]], of["q"][w[x]], of["back"][u[x]], of["p"][w[x]])
                yield pa.RecordBatch.from_arrays([pa.array(_pair(t.key[u[x]], t.key[w[x]]).view(np.int64)), pa.array(of["cw"][w[x]]), pa.array(lp.astype(np.float32))], ["k", "cw", "lp"])

    got = model.many.where(F.col("kind") == NEAR).mapInArrow(run, "k long, cw long, lp float").toArrow()
    k = got["k"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(k)
    return k[order], {c: got[c].to_numpy()[order] for c in ("cw", "lp")}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, burn_in: int = BURN_IN, sweeps: int = SWEEPS) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from rows whose crc32(id as text) mod 7 is not 2. Tokens are words
    between white space, A-Z lower-cased, and one end. ``base_score`` is that of
    add-one unigrams, ``score`` the model's log10 probability. Null and empty
    texts are the end alone; a null id is not held out. Repeated rows each count
    and give a row each. With no training rows every token is unknown; an empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("held_out", F.expr("coalesce(crc32(cast(id as string)) % 7 = 2, false)"))
    # rows equal in id and text score alike, so their hash may stand for them
    src = src.withColumn("row", F.xxhash64("id", "text"))
    model = train(src, burn_in, sweeps, seed)
    n_all, v_all, parts, shares = model.tokens, model.known, PASSES, model.shares
    unseen, ones = model.unseen, model.ones

    words_sent, words_top = _sent(spark, (model.key, model.top))
    pairs_sent, pairs_top = _sent(spark, (model.key, {}), _most(model, words_top))
    dropped(model.many)
    base_of = lambda c: np.log10((c + 1) / (n_all + v_all + 1))

    def dealt_sums(row: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        return _dealt(_share(B.mix(row.view(np.uint64)), shares), ROW, row, *(c.astype(t) for c, t in zip(columns, TYPES[ROW].split()[1:])))

    def missed(part: int) -> DataFrame:
        """Blocks of the pairs of a part's tokens whose terms tasks do not hold; in part 0 also each text's sums over the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, t = pairs_top()
            base, chance = base_of(t.columns["cw"]), t.columns["lp"].astype(float)
            held: list[tuple[np.ndarray, ...]] = []
            own: list[tuple[np.ndarray, ...]] = []
            n_held = n_own = 0
            for batch in B.slices(batches, 0, rows=500, size=SLICE):
                n = batch.num_rows
                row = batch.column(1).to_numpy()
                h, first = _tokens(batch.column(0))
                u, to = _homes(words, h, first, parts * shares)
                doc = np.repeat(np.arange(n), np.diff(first))
                if part:
                    mine = np.flatnonzero((to >= part * shares) & (to < (part + 1) * shares))
                    u, h, doc, to = u[mine], h[mine], doc[mine], to[mine]
                k = _pair(u, h)
                place = t.find(k)
                miss = place < 0
                if part == 0:
                    hit = ~miss
                    both = [np.bincount(doc[hit], x[place[hit]] if hit.any() else [], minlength=n).astype(float) for x in (base, chance)]
                    known = np.bincount(doc[hit], t.columns["cw"][place[hit]] > 0 if hit.any() else [], minlength=n)
                    own.append((row, np.ones(n), np.diff(first), known, *both))
                    n_own += n
                    if n_own > FLUSH // 8:
                        yield dealt_own(own)
                        own, n_own = [], 0
                    miss &= to < shares
                # a pair that comes again in a text is a row again
                mine = np.flatnonzero(miss)
                held.append((to[mine], k[mine], row[doc[mine]]))
                n_held += len(mine)
                if n_held > FLUSH:
                    yield dealt_tokens(held)
                    held, n_held = [], 0
            if n_held:
                yield dealt_tokens(held)
            if n_own:
                yield dealt_own(own)

        def dealt_tokens(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            to, k, row = map(np.concatenate, zip(*held))
            return _dealt(to, TOKEN, k, row)

        def dealt_own(own: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            row, *columns = (np.concatenate(x) for x in zip(*own))
            return dealt_sums(row, columns)

        return src.select("text", "row").mapInArrow(run, BLOCKS)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by row over the pairs of a share."""
        t = words_top()[0]
        for _, found in _gather(batches):
            for x in found.pop(ROW, []):  # sums already
                row, *columns = _undealt([x], TYPES[ROW])
                yield dealt_sums(row, columns)
            terms = Terms(t, unseen, ones, found)
            ks, bases, chance = [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0)]
            for kind in (NONE, ONCE, MANY):
                for x in found.pop(kind, []):
                    u, w, c = _customers(kind, _undealt([x], TYPES[kind]))
                    for cut in _cuts(len(u)):
                        cw, lp = terms.pairs(u[cut], w[cut], c[cut])
                        ks.append(_pair(u[cut], w[cut]))
                        bases.append(np.where(cw > 0, 1.0, -1.0) * -base_of(cw))  # its sign tells known words
                        chance.append(lp)
            key, base, lp = (np.concatenate(x) for x in (ks, bases, chance))
            order = np.argsort(key)
            key, base, lp = key[order], base[order], lp[order]
            k, row = found.take(TOKEN)
            if not len(k):
                continue
            order = np.argsort(k)
            k, row = k[order], row[order]
            place = _find(key, k)
            if (place < 0).any():
                raise ValueError("a pair without a term")
            base = base[place]
            row, known, base, total = _summed(row, (base > 0).astype(np.int64), -np.abs(base), lp[place])
            yield dealt_sums(row, [np.zeros(len(row)), np.zeros(len(row)), known, base, total])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pitman_yor")
        for _, found in _gather(batches):
            row, *columns = _summed(*found.take(ROW))
            yield from pa.table([pa.array(row), *(pa.array(c.astype(np.int64)) for c in columns[:3]), *map(pa.array, columns[3:])], names=["row", "m", "n_tokens", "known", "base", "total"]).to_batches(DRAWN)

    done = []
    for p in range(parts):
        own = (F.col("share") >= p * shares) & (F.col("share") < (p + 1) * shares)
        blocks = _met(shares, matched, missed(p), *(x.where(own) for x in model.pairs), model.rare.where(own)).repartitionById(shares, "share")
        done.append(written(blocks.mapInArrow(summed, "row long, m long, n_tokens long, known long, base double, total double"), f"scores{p}"))
    dropped(model.rare, *model.pairs)
    words_sent.destroy()
    pairs_sent.destroy()
    by = reduce(DataFrame.unionAll, done).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("m", "n_tokens", "known", "base", "total")))
    each = lambda x: (F.col(x) / F.col("m")).cast("long")
    return (
        src.select("row", "id", "held_out")
        .join(by, "row")
        .select("id", "held_out", each("n_tokens").alias("n_tokens"), each("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") / F.col("m")).alias("base_score"), (F.col("total") / F.col("m")).alias("score"))
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """``(held_out, perplexity, base_perplexity, n_tokens)``: of the model and of the base, by fold."""
    per = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all ``documents``."""
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
