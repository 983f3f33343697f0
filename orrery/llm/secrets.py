"""Secret scans by grammar inference.

Base patterns find labelled credentials. Of all their distinct strings a prefix
tree is built for each kind, and statistically compatible states are merged into
a probabilistic automaton. Two states are compatible if their frequencies of
ending and of symbol classes agree (Hoeffding bounds, down the tree) and if the
lengths still to come agree (a bound of Dvoretzky, Kiefer and Wolfowitz), so that
formats of fixed length keep their positions; a state met by few strings says too
little for that and may merge only with a state of its own depth. Prefixes beyond
``NODES`` of the most frequent ones share a state for each depth. All strings are
then counted along the automaton.

All candidates, runs of eight or more credential characters that no base span
covers, are scored by the log likelihood of the best automaton, its ending
probability included, over that of ordinary text, a trigram model of the
characters of ordinary runs. Those above a threshold fitted on held-out strings
of both sides are added to the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm import bytewords as B
from orrery.llm.resident import only
from orrery.llm.tables import table
from orrery.operators.arrange import with_rank
from orrery.session import dropped, written

#: Prefixes by kind that have a state of their own before merging, at most, and characters of the longest.
NODES, DEEP = 10_000, 64
#: Depths with a shared state, and lengths still to come that are told apart.
SHARED, LENGTHS = 128, 128
#: Distinct strings, and their characters, that a task holds before it passes them on.
HELD, HELD_CHARS = 200_000, 8 << 20
#: Least characters of a candidate.
SHORTEST = 8
#: Confidence of the bounds, and strings from which a state may merge with one of another depth.
ALPHA, ENOUGH = 0.05, 20
#: Of either side one string in so many is held out for the threshold.
HELD_OUT = 5
#: Shares of held-out labelled strings left out below and of ordinary runs left out above, and the threshold's least value in nats: ordinary runs exceed it by chance once in e^16.
BELOW, ABOVE, LEAST = 0.02, 0.01, 16.0
#: Where the threshold lies between the ordinary runs (0) and the labelled strings (1).
BETWEEN = 2 / 3
#: Longer runs are scored one by one.
LONG = 2000

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")
_keyword = re.compile(r"passw|secret|token|api", re.I | re.A)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
EDGE = len(ALPHABET)
#: Number of each byte in the alphabet, and whether it is one of a candidate's.
CODE = np.full(256, EDGE, np.int16)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(EDGE)
RUN = CODE < EDGE
RUN[ord(".")] = False
#: Symbol class of each character: upper case, lower case, digit, or itself.
CLASS = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3, 4, 5, 6, 7, 8])
N_CLASS = 9


def codes(s: str) -> np.ndarray:
    return CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, credential) of the patterns of labels and access ids; code points, end exclusive."""
    out = []
    if ("=" in text or ":" in text) and _keyword.search(text):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) in bytes of all runs of ``SHORTEST`` or more credential characters, in order."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = RUN[raw]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # runs that texts' bounds cut
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = np.unique(cut[RUN[raw[cut]] & RUN[raw[cut - 1]]]) if len(raw) and len(cut) else np.empty(0, np.int64)
    begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    keep = end - begin >= SHORTEST
    begin, end = begin[keep], end[keep]
    return np.searchsorted(offsets, begin, "right") - 1, begin, end


def _child(node: int, k: int) -> int:
    """The number of the prefix that class ``k`` makes of another; the empty one is 0."""
    h = ((node ^ (k + 1)) * 0x9E3779B97F4A7C15 + k + 1) & (2**64 - 1)
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> 1


#: A string at each of its prefixes: prefix, the one before it, its last class, its length, next character (EDGE: ends), length to come.
VISIT = ["node", "parent", "k", "depth", "char", "rest"]


def visits(strings: list[str]) -> list[tuple[int, ...]]:
    out = []
    for s in strings:
        x, node, parent, k = codes(s).tolist(), 0, -1, -1
        for i, c in enumerate([*x[: DEEP + 1], EDGE][: DEEP + 1]):
            out.append((node, parent, k, i, c, min(len(x) - i, LENGTHS)))
            if c < EDGE:
                k = int(CLASS[c])
                node, parent = _child(node, k), node
    return out


class Automaton:
    """A probabilistic automaton merged from the prefix tree of strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        chars, rest, nodes = Counter(), Counter(), {}
        for node, parent, k, depth, c, r in visits(strings):
            chars[node, c] += 1
            rest[node, r] += 1
            nodes[node] = (node, parent, k, depth)
        self._learn(list(nodes.values()), [(*x, n) for x, n in chars.items()], [(*x, n) for x, n in rest.items()], alpha)
        self.fit(self.run(strings))

    @classmethod
    def of_tree(cls, nodes: list, chars: list, rest: list, alpha: float = ALPHA) -> Automaton:
        """The states of a tree by its rows (node, parent, k, depth), (node, char, n) and (node, rest, n); ``fit`` gives them probabilities."""
        a = cls.__new__(cls)
        a._learn(nodes, chars, rest, alpha)
        return a

    def _learn(self, nodes: list, chars: list, rest: list, alpha: float) -> None:
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[int, int]] = []
        self.count: list[Counter] = []  # by class
        self.rest: list[Counter] = []  # lengths still to come
        self.ends: list[int] = []
        self.total: list[int] = []
        self.depth: list[int] = []
        self._node(0)
        number = {0: 0}
        for node, parent, k, depth in sorted(nodes, key=lambda x: (x[3], x[1], x[2])):
            if depth:
                number[node] = self.next[number[parent]][k] = self._node(depth)
        for node, c, n in chars:
            at = number[node]
            self.total[at] += n
            if c == EDGE:
                self.ends[at] += n
            else:
                self.count[at][int(CLASS[c])] += n
        for node, r, n in rest:
            self.rest[number[node]][r] += n
        self._merge()
        # where a class leads: to its state, else to the one that strings of that depth share
        size = len(self.states)
        place = {x: i for i, x in enumerate(self.states)}
        depth = np.array([self.depth[x] for x in self.states] + list(range(SHARED + 1)))
        self.ways = np.repeat(size + np.minimum(depth + 1, SHARED)[:, None], N_CLASS, axis=1)
        for i, x in enumerate(self.states):
            for k, y in self.next[x].items():
                self.ways[i, k] = place[y]
        del self.next, self.count, self.rest, self.ends, self.total, self.depth

    def run(self, strings: list[str]) -> np.ndarray:
        """[state, character]: how often strings meet each character, or their end (EDGE), in each state."""
        out = np.zeros((len(self.ways), EDGE + 1), np.int64)
        ways, kinds = self.ways.tolist(), CLASS.tolist()
        for s in strings:
            x, at, path = codes(s).tolist(), 0, []
            for c in x:
                path.append(at)
                at = ways[at][kinds[c]]
            path.append(at)
            np.add.at(out, (path, [*x, EDGE]), 1)
        return out

    def _node(self, depth: int) -> int:
        for x, v in ((self.next, {}), (self.count, Counter()), (self.rest, Counter()), (self.ends, 0), (self.total, 0), (self.depth, depth)):
            x.append(v)
        return len(self.total) - 1

    def _far(self, f: float, n: int, g: float, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _lengths_differ(self, x: int, y: int) -> bool:
        n, m = self.total[x], self.total[y]
        a = b = most = 0.0
        for k in sorted(set(self.rest[x]) | set(self.rest[y])):
            a, b = a + self.rest[x][k] / n, b + self.rest[y][k] / m
            most = max(most, abs(a - b))
        return most > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        if min(self.total[a], self.total[b]) < ENOUGH and self.depth[a] != self.depth[b]:
            return False
        if self._lengths_differ(a, b):
            return False
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            n, m = self.total[x], self.total[y]
            if self._far(self.ends[x], n, self.ends[y], m):
                return False
            for k in set(self.next[x]) | set(self.next[y]):
                if self._far(self.count[x][k], n, self.count[y][k], m):
                    return False
                if k in self.next[x] and k in self.next[y]:
                    todo.append((self.next[x][k], self.next[y][k]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.total[x] += self.total[y]
            self.count[x] += self.count[y]
            self.rest[x] += self.rest[y]
            for k, z in self.next[y].items():
                if k in self.next[x]:
                    todo.append((self.next[x][k], z))
                else:
                    self.next[x][k] = z

    def _merge(self) -> None:
        red, order = {0}, [0]
        while True:
            blue = {self.next[r][k]: (r, k) for r in order for k in sorted(self.next[r]) if self.next[r][k] not in red}
            if not blue:
                break
            node = max(blue, key=lambda x: (self.total[x], -x))
            into = next((r for r in sorted(order, key=lambda r: (self.depth[r] != self.depth[node], r)) if self._compatible(r, node)), None)
            if into is None:
                red.add(node)
                order.append(node)
            else:
                at, k = blue[node]
                self.next[at][k] = into
                self._fold(into, node)
        self.states = order

    def fit(self, counts: np.ndarray, more: float = 0.1, more_chars: float = 2.0) -> None:
        """Log probabilities [state, character], of ending [state], and next states, smoothed so that none is 0 and each state's sum to 1.

        By what ``run`` counts of all strings; states that none of them meets go.
        """
        met = counts.sum(axis=1) > 0
        met[0] = True
        # states that a class of a met state may lead to are met, but for classes that were not
        place = np.cumsum(met) - 1
        counts, ways = counts[met], self.ways[met]
        chars, ends = counts[:, :EDGE].astype(float), counts[:, EDGE]
        usual = 1 + chars.sum(axis=0)
        in_class = np.bincount(CLASS, usual, minlength=N_CLASS)
        usual = usual / in_class[CLASS]
        self.states = list(range(len(counts)))
        by_class = np.stack([np.bincount(CLASS, x, minlength=N_CLASS) for x in chars])
        all_ = counts.sum(axis=1) + more * (N_CLASS + 1)
        self.log = np.log(((by_class + more) / all_[:, None])[:, CLASS] * (chars + more_chars * usual) / (by_class + more_chars)[:, CLASS])
        self.log_end = np.log((ends + more) / all_)
        # a class that was not met goes where most strings go from here
        most, none = by_class.argmax(axis=1), by_class.sum(axis=1) == 0
        to = np.where(by_class > 0, ways, ways[self.states, most][:, None])
        self.to = np.where(none[:, None], np.array(self.states)[:, None], place[to])[:, CLASS].astype(np.int32)

    def log_prob(self, s: str) -> float:
        """Log probability of the string, its end included."""
        at, total = 0, 0.0
        for c in codes(s).tolist():
            total += float(self.log[at, c])
            at = int(self.to[at, c])
        return total + float(self.log_end[at])


def trigrams(strings: list[str]) -> np.ndarray:
    """[first, second, third]: how often characters follow each other, two begins and an end (EDGE) included."""
    k = EDGE + 1
    out = np.zeros(k**3, np.int64)
    at = 0
    while at < len(strings):
        to, size = at, 0
        while to < len(strings) and size < HELD_CHARS // 8:
            size += len(strings[to])
            to += 1
        n = np.fromiter(map(len, strings[at:to]), np.int64, to - at)
        c = np.full(size + 3 * len(n), EDGE, np.int64)
        inner = np.ones(len(c), bool)
        begin = np.cumsum(n + 3) - (n + 3)
        inner[begin] = inner[begin + 1] = inner[begin + n + 2] = False
        c[inner] = codes("".join(strings[at:to]))
        ok = np.ones(len(c), bool)
        ok[begin] = ok[begin + 1] = False
        three = (c[:-2] * k + c[1:-1]) * k + c[2:]
        out += np.bincount(three[ok[2:]], minlength=k**3)
        at = to
    return out.reshape(k, k, k)


class Trigrams:
    """Characters of ordinary runs, their begin and end included; of strings, or of what ``trigrams`` counts of them."""

    def __init__(self, strings: list[str] | np.ndarray):
        three = (strings if isinstance(strings, np.ndarray) else trigrams(strings)).astype(float)
        two = three.sum(axis=0)
        one = 0.5 + two.sum(axis=0)
        p1 = one / one.sum()

        def under(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            """Contexts met often speak for themselves, others pass to shorter ones, and what came once says little."""
            less = np.minimum(n, 0.95)
            return (n - less + (5 + less.sum(axis=-1, keepdims=True)) * shorter) / (5 + n.sum(axis=-1, keepdims=True))

        table = lambda three, two: np.log(under(three, under(two, p1)[None])).astype(np.float32)
        self.log = table(three, two)
        #: As the other strings have it, for a string that is one of those counted.
        self.log_of_others = table(np.maximum(three - 1, 0), np.maximum(two - 1, 0))

    def of(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, counted: bool = False) -> np.ndarray:
        """Log probabilities of chars[begin:end], ends included; by the other strings where these were ``counted``."""
        n = end - begin
        at = np.cumsum(n + 3) - (n + 3)
        c = np.full(int((n + 3).sum()), EDGE, np.int16)
        doc = np.repeat(np.arange(len(n)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        c[at[doc] + 2 + inner] = chars[begin[doc] + inner]
        each = np.zeros(len(c))
        each[2:] = (self.log_of_others if counted else self.log)[c[:-2], c[1:-1], c[2:]]
        mask = np.ones(len(c), bool)
        mask[at] = mask[at + 1] = False
        each[~mask] = 0
        return np.add.reduceat(each, at) if len(at) else np.empty(0)


def held_out(x: str) -> bool:
    return zlib.crc32(x.encode()) % HELD_OUT == 0


def threshold(low: Callable[[int], float], n_low: int, high: Callable[[int], float], n_high: int) -> float:
    """Between the scores of labelled strings and of ordinary runs, given by their places in order from 0."""
    bottom, top = low(int(BELOW * n_low)), high(n_high - 1 - int(ABOVE * n_high))
    return max(LEAST, min(bottom, top + BETWEEN * (bottom - top)))


class Grammar:
    """Automata by kind, a model of ordinary runs, and the threshold between them."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        out = held_out
        fitted = {k: [x for x in v if not out(x)] or v for k, v in sorted(labelled.items()) if v}
        self.automata = {k: Automaton(v) for k, v in fitted.items()}
        self.ordinary = Trigrams(ordinary) if ordinary else None
        if self.automata and self.ordinary:
            # runs more like the credentials than like the other runs are unlabelled credentials, not ordinary
            ordinary = [x for x, y in zip(ordinary, self.scores(ordinary, counted=True)) if y < LEAST]
            self.ordinary = Trigrams([x for x in ordinary if not out(x)] or ordinary) if ordinary else None
        self.limit = math.inf
        if self.automata and self.ordinary:
            low = sorted(self.scores([x for v in labelled.values() for x in v if out(x)] or [x for v in labelled.values() for x in v]))
            high = sorted(self.scores([x for x in ordinary if out(x)] or ordinary))
            self.limit = threshold(low.__getitem__, len(low), high.__getitem__, len(high))

    @classmethod
    def of(cls, automata: dict[str, Automaton], ordinary: Trigrams | None, limit: float = math.inf) -> Grammar:
        g = cls.__new__(cls)
        g.automata, g.ordinary, g.limit = automata, ordinary, limit
        return g

    def score(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, counted: bool = False) -> np.ndarray:
        """Log likelihood ratios of chars[begin:end] (numbers in the alphabet)."""
        if not len(begin):
            return np.empty(0)
        n = end - begin
        best = np.full(len(n), -np.inf)
        short = np.flatnonzero(n <= LONG)
        order = short[np.argsort(-n[short], kind="stable")]
        size = n[order]
        for a in self.automata.values():
            state, total = np.zeros(len(order), np.int32), np.zeros(len(order))
            live = len(order)
            for j in range(int(size[0]) if len(size) else 0):
                live = int(np.searchsorted(-size[:live], -j, "left"))
                c = chars[begin[order[:live]] + j]
                total[:live] += a.log[state[:live], c]
                state[:live] = a.to[state[:live], c]
            best[order] = np.maximum(best[order], total + a.log_end[state])
            for i in np.flatnonzero(n > LONG).tolist():
                at, sum_, log, to = 0, 0.0, a.log.tolist(), a.to.tolist()
                for c in chars[begin[i] : end[i]].tolist():
                    sum_ += log[at][c]
                    at = to[at][c]
                best[i] = max(best[i], sum_ + float(a.log_end[at]))
        return best - self.ordinary.of(chars, begin, end, counted)

    def scores(self, strings: list[str], counted: bool = False) -> list[float]:
        n = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(n)
        return self.score(codes("".join(strings)), ends - n, ends, counted).tolist()

    def secrets(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each is a secret by its format."""
        if not (self.automata and self.ordinary):
            return np.zeros(len(begin), bool)
        return self.score(chars, begin, end) >= self.limit


Span = tuple[int, int, int, str]


def candidates(texts: list[str | None], raw: np.ndarray, offsets: np.ndarray) -> tuple[list[list[Span]], np.ndarray, np.ndarray, np.ndarray]:
    """All base spans by text, and (text, begin, end) in bytes of the runs and what base spans leave of them."""
    found: list[list[Span]] = [base_spans(t) if t else [] for t in texts]
    text, begin, end = runs(raw, offsets)
    in_chars = lambda i, at: len(raw[offsets[i] : at].tobytes().decode("utf-8", "ignore"))
    taken: dict[int, list[tuple[int, int]]] = {}
    for i, spans in enumerate(found):
        if spans:
            t = texts[i]
            taken[i] = [(int(offsets[i]) + len(t[:a].encode()), int(offsets[i]) + len(t[:b].encode())) for a, b, _, _ in spans]
    # a run of 32 hex digits lies within a run of credential characters
    for j in np.flatnonzero(end - begin >= 32).tolist():
        i, a = int(text[j]), int(begin[j])
        for m in _hex.finditer(raw[a : int(end[j])].tobytes().decode()):
            at = in_chars(i, a + m.start())
            found[i].append((at, at + m.end() - m.start(), 2, m[0]))
            taken.setdefault(i, []).append((a + m.start(), a + m.end()))
    if taken:
        hit = np.isin(text, list(taken))
        more: list[tuple[int, int, int]] = []
        for i, a, b in zip(text[hit].tolist(), begin[hit].tolist(), end[hit].tolist()):
            for x, y in sorted(taken[i]):
                if y <= a or x >= b:
                    continue
                if x - a >= SHORTEST:
                    more.append((i, a, x))
                a = max(a, y)
            if b - a >= SHORTEST:
                more.append((i, a, b))
        extra = np.array(more, np.int64).reshape(-1, 3)
        text, begin, end = (np.concatenate([x[~hit], extra[:, k]]) for k, x in enumerate((text, begin, end)))
    for x in found:
        x.sort(key=lambda s: (s[0], s[2]))
    return found, text, begin, end


def all_spans(texts: list[str | None], column: pa.Array, grammar: Grammar) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans by text, and those of the method; each in order of start, then kind."""
    raw, offsets = B.buffers(column)
    base, text, begin, end = candidates(texts, raw, offsets)
    added: list[list[Span]] = [[] for _ in texts]
    hit = np.flatnonzero(grammar.secrets(CODE[raw], begin, end)) if len(raw) else []
    for j in sorted(hit, key=lambda j: (text[j], begin[j])):
        i, s = int(text[j]), raw[begin[j] : end[j]].tobytes().decode()
        at = len(raw[offsets[i] : begin[j]].tobytes().decode("utf-8", "ignore"))
        added[i].append((at, at + len(s), 3, s))
    return base, added


def strings_of(src: DataFrame) -> DataFrame:
    """``(value, kinds, held_out)``: all distinct strings of the base spans and all other candidates of ``src`` (id, text); bit k of kinds is set for kind k, bit 3 for candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        held: dict[str, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int32()), pa.array([held_out(x) for x in held], pa.bool_())], ["value", "kinds", "held_out"])

        for batch in B.slices(batches, 0, rows=512):
            raw, offsets = B.buffers(batch.column(0))
            base, _, begin, end = candidates(batch.column(0).to_pylist(), raw, offsets)
            got = [(x, 1 << k) for v in base for _, _, k, x in v]
            got += [(raw[a:b].tobytes().decode(), 8) for a, b in zip(begin.tolist(), end.tolist())]
            for x, kind in got:
                if x not in held:
                    size += len(x)
                    held[x] = kind
                else:
                    held[x] |= kind
            if len(held) > HELD or size > HELD_CHARS:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    found = src.select("text").mapInArrow(run, "value string, kinds int, held_out boolean")
    return found.groupBy("value", "held_out").agg(F.bit_or("kinds").alias("kinds"))


def _counted(df: DataFrame, count: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``count`` makes of the columns of a part of ``df``, as lists: an array of one shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        total = none
        for batch in B.slices(batches, 0, rows=5000, size=1 << 20):
            total = total + count(*(x.to_pylist() for x in batch.columns)).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = count(*([] for _ in df.columns))
    shape, none = out.shape, np.zeros(1, np.int64)
    got = df.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each cell
    out = np.zeros(out.size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(shape)


def automaton(values: DataFrame) -> Automaton:
    """The automaton of all strings of ``values`` (value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                v = np.array(visits(batch.column(0).slice(at, 1000).to_pylist()), np.int64).reshape(-1, len(VISIT))
                yield pa.RecordBatch.from_arrays([pa.array(v[:, i]) for i in range(len(VISIT))], VISIT)

    seen = values.select("value").mapInArrow(run, ", ".join(f"{x} long" for x in VISIT))
    seen = written(seen.groupBy(*VISIT).agg(F.count("*").alias("n")), "visits")
    nodes = written(seen.groupBy(*VISIT[:4]).agg(F.sum("n").alias("n")), "nodes")
    # prefixes met by as many strings as any that has a state has a state
    least, above = 1, 0
    for x in sorted(nodes.groupBy("n").count().collect(), key=lambda x: -x["n"]):  # sums of distinct values: few
        above += x["count"]
        if above > NODES:
            least = x["n"] + 1
            break
    some = nodes.where((F.col("n") >= least) | (F.col("depth") == 0))
    kept = seen.join(some.select("node"), "node", "left_semi")
    rows = lambda *by: [tuple(r) for r in kept.groupBy(*by).agg(F.sum("n")).collect()]
    a = Automaton.of_tree([tuple(r) for r in some.select(*VISIT[:4]).collect()], rows("node", "char"), rows("node", "rest"))  # at most NODES prefixes
    dropped(seen, nodes)
    a.fit(_counted(values.select("value"), a.run))
    return a


def learn(src: DataFrame) -> Grammar:
    """What ``Grammar`` makes of lists, of all strings of ``src`` (id, text) in tasks."""
    spark = src.sparkSession
    every = written(strings_of(src), "strings")
    ordinary = every.where("kinds = 8")
    kinds = {k: every.where(F.col("kinds").bitwiseAND(1 << i) > 0) for i, k in enumerate(KINDS[:3])}
    n = every.agg(*(F.count_if((F.col("kinds").bitwiseAND(1 << i) > 0) & (F.lit(whole) | ~F.col("held_out"))).alias(f"{k}{whole}") for i, k in enumerate(KINDS[:3]) for whole in (False, True)), F.count_if(F.col("kinds") == 8).alias("ordinary")).first()
    automata = {k: automaton(v if not n[f"{k}False"] else v.where("not held_out")) for k, v in sorted(kinds.items()) if n[f"{k}True"]}
    if not automata or not n["ordinary"]:
        dropped(every)
        return Grammar.of(automata, None)
    first = Grammar.of(automata, Trigrams(_counted(ordinary.select("value"), trigrams)))
    sent = spark.sparkContext.broadcast(first)

    def common(values: list, held: list) -> np.ndarray:
        """Trigrams of what is ordinary by the first model: of strings not held out, and of all."""
        some = [(x, out) for x, out, y in zip(values, held, sent.value.scores(values, counted=True)) if y < LEAST]
        return np.stack([trigrams([x for x, out in some if not out]), trigrams([x for x, _ in some])])

    fit, all_ = _counted(ordinary.select("value", "held_out"), common)
    if not all_.any():
        dropped(every)
        sent.destroy()
        return Grammar.of(automata, None)
    g = Grammar.of(automata, Trigrams(fit if fit.any() else all_))
    final = spark.sparkContext.broadcast(g)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        for batch in B.slices(batches, 0, rows=5000, size=1 << 20):
            values, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            high = kinds == 8
            low = ~high
            times = sum((kinds >> i) & 1 for i in range(3))  # as often as it is a string of a kind
            high[high] = np.array(sent.value.scores([x for x, k in zip(values, high) if k], counted=True)) < LEAST
            times[high] = 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(final.value.scores(values)), times)), pa.array(np.repeat(low, times))], ["y", "low"])

    # of a side without held-out strings all are scored
    rest = all_.sum() == fit.sum()
    no_low = all(n[f"{k}True"] == n[f"{k}False"] for k in KINDS[:3])
    sides = F.col("held_out") | (F.lit(bool(rest)) & (F.col("kinds") == 8)) | (F.lit(no_low) & (F.col("kinds") != 8))
    scores = written(every.where(sides).select("value", "kinds").mapInArrow(scored, "y double, low boolean"), "scores")
    sizes = {r["low"]: r["count"] for r in scores.groupBy("low").count().collect()}

    def placed(low: bool) -> Callable[[int], float]:
        ranked = with_rank(scores.where(F.col("low") == low).select("y"), ["y"], "_rank")
        return lambda place: ranked.where(F.col("_rank") == place).first()["y"]

    g.limit = threshold(placed(True), sizes[True], placed(False), sizes[False])
    dropped(every, scores)
    for x in (sent, final):
        x.destroy()
    return g


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_format, base_sha256, spans, secrets)`` for every row of ``docs``.

    ``secrets`` has start, end, kind and value of every span in order of start,
    then kind; ``spans`` is the same as kind:start:end, comma-joined. Offsets are
    code points, ends exclusive. Null and empty texts have none; repeated rows
    give a row each; other columns are ignored; an empty table gives no rows.
    Without labelled credentials or ordinary runs nothing is added to the base
    spans. ``grammar`` takes the place of one learned from ``docs``.
    """
    src = _source(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(grammar or learn(src))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        said = lambda v: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in v)
        for batch in B.slices(batches, 1, rows=512):
            cols: list[list] = [[] for _ in range(7)]
            for base, added in zip(*all_spans(batch.column(1).to_pylist(), batch.column(1), held.value)):
                every = sorted([*base, *added], key=lambda x: (x[0], x[2]))
                for i in range(4):
                    cols[i].append(sum(x[2] == i for x in every))
                cols[4].append(hashlib.sha256(said(base).encode()).hexdigest())
                cols[5].append(said(every))
                cols[6].append([{"start": a, "end": b, "kind": KINDS[k], "value": s} for a, b, k, s in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], span)], names)

    names = ["id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "secrets"]
    return src.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, secrets array<struct<start:long,end:long,kind:string,value:string>>")


def redact(docs: DataFrame, mark: str = "<secret>", id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; overlapping spans become one mark. Nulls stay null, rows and other columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(grammar or learn(_source(docs, id_col, text_col)))
    at = docs.columns.index(text_col)

    def clean(text: str | None, spans: list[Span]) -> str | None:
        out, done = [], 0
        for a, b, _, _ in sorted(spans):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("secrets")
        for batch in B.slices(batches, at, rows=512):
            cols, texts = list(batch.columns), batch.column(at).to_pylist()
            cols[at] = pa.array([clean(t, [*x, *y]) for t, x, y in zip(texts, *all_spans(texts, batch.column(at), held.value))], pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    d = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return d.mapInArrow(run, StructType(d.schema.fields))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all ``documents``."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")
