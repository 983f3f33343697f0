"""Benchmark decontamination by winnowing.

Every text is reduced to winnowed fingerprints: the rightmost least hash of
8-word grams in each window of six. Any 13 shared words hold six grams, so both
sides pick the same one, and the fingerprint join misses no shared window.
Matching fingerprints are extended to the 13-word windows around them, and the
words of every confirmed window are hit. Items of fewer than 13 words are
looked up whole.

The benchmark is the query set: it is read in blocks of bounded size, and all
documents pass each block. With one block documents are neither shuffled nor
joined; with several, each but the last gives only the words and items it hits,
which are joined to the documents at the end. Windows are compared by a 64-bit
hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bytewords as B
from orrery.llm.resident import only
from orrery.llm.tables import table
from orrery.session import written

WINDOW, GRAM = 13, 8
#: Text of benchmark items that one block, and so one broadcast, may hold.
BLOCK_BYTES = 8 << 20


def winnow(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Places in ``at`` order of the rightmost least hash of each ``span`` grams that follow one another."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    full = np.flatnonzero(at[span - 1 :] - at[:n] == span - 1)
    best, where = h[full].copy(), full.copy()
    for j in range(1, span):
        other = h[full + j]
        take = other <= best
        best[take], where[take] = other[take], full[take] + j
    return np.unique(where)


def _windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hash by word place (0 where none begins) and whether one begins there."""
    g, at = B.grams(h, first, k)
    out, ok = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    out[at], ok[at] = g, True
    return out, ok


class Index:
    """Fingerprints of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.ids = [x for x, _ in items]
        self.window, self.gram = window, gram
        h, first = B.words(pa.array([t for _, t in items], pa.string()), B.PUNCT)
        g, at = B.grams(h, first, gram)
        pick = winnow(g, at, window - gram + 1)
        order = np.argsort(g[pick], kind="stable")
        self.prints, self.places = g[pick][order], at[pick][order]
        self.whole, self.begins = _windows(h, first, window)
        self.item = B.owner(np.arange(len(h)), first)
        n = np.diff(first)
        self.short = {}
        for k in range(1, window):
            which = np.flatnonzero(n == k)
            if len(which):
                keys = B.whole(h, first, which, k)
                order = np.argsort(keys, kind="stable")
                self.short[k] = (keys[order], which[order])

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a window's first word, its words, item) of all windows that occur, possibly repeated."""
        starts, spans, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        g, at = B.grams(h, first, self.gram)
        pick = winnow(g, at, self.window - self.gram + 1)
        i, j = _lookup(g[pick], self.prints)
        if len(i):
            doc_at, item_at = at[pick][i], self.places[j]
            whole, begins = _windows(h, first, self.window)
            for back in range(self.window - self.gram + 1):
                a, b = doc_at - back, item_at - back
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                ok = begins[a] & self.begins[b] & (whole[a] == self.whole[b])
                starts.append(a[ok])
                items.append(self.item[b[ok]])
                spans.append(np.full(int(ok.sum()), self.window))
        for k, (keys, which) in self.short.items():
            g, at = B.grams(h, first, k)
            i, j = _lookup(g, keys)
            starts.append(at[i])
            items.append(which[j])
            spans.append(np.full(len(i), k))
        return np.concatenate(starts), np.concatenate(spans), np.concatenate(items)


def _lookup(queries: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, key) places with equal values; ``keys`` ascend."""
    if not len(keys) or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo = np.searchsorted(keys, queries, "left")
    found = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == queries)
    lo = lo[found]
    n = np.searchsorted(keys, queries[found], "right") - lo
    i = np.repeat(found, n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return i, j


def _blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for x in bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator(prefetchPartitions=False):
        block.append((x.i, x.t))
        size += len(x.t) + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _mark(index: Index | None, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Whether each word is hit, and the items of each text that has some."""
    if index is None:
        return np.zeros(len(h), bool), {}
    start, span, item = index.hits(h, first)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + span, -1)
    items: dict[int, set[str]] = {}
    if len(start):
        for d, i in np.unique(np.stack([B.owner(start, first), item], 1), axis=0).tolist():
            items.setdefault(d, set()).add(index.ids[i])
    return np.cumsum(edge[:-1]) > 0, items


def _found(docs: DataFrame, index: Broadcast) -> DataFrame:
    """``(row, hit, items)`` of the texts (columns text, row) that a block hits: a bit for each word, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        for batch in B.slices(batches, 0, rows=2000):
            h, first = B.words(batch.column(0), B.PUNCT)
            hit, items = _mark(index.value, h, first)
            some = sorted(items)
            bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in some]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some, pa.int64())), pa.array(bits, pa.binary()), pa.array([sorted(items[d]) for d in some], pa.list_(pa.string()))], ["row", "hit", "items"])

    return docs.select("text", "row").mapInArrow(run, "row long, hit binary, items array<string>")


def _summed(docs: DataFrame, index: Broadcast) -> DataFrame:
    """The results of ``docs`` (id, text, hits, items) by a block's hits and those found before."""
    out = ["id", "n_words", "n_hit", "n_items", "items_sha256", "spans"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first = B.words(batch.column(1), B.PUNCT)
        hit, found = _mark(index.value, h, first)
        n = np.diff(first)
        items = [found.get(i, set()) | set(x or ()) for i, x in enumerate(batch.column(3).to_pylist())]
        for d, before in enumerate(batch.column(2).to_pylist()):
            for bits in before or ():
                hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n[d])).astype(bool)
        total = np.concatenate([[0], np.cumsum(hit)])
        spans = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            runs = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))) if total[b] > total[a] else np.empty(0, np.int64)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(runs[::2], runs[1::2])])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n.astype(np.int64)),
                pa.array(total[first[1:]] - total[first[:-1]]),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            out,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        yield from map(one, B.slices(batches, 1, rows=2000))

    return docs.select("id", "text", "hits", "items").mapInArrow(run, "id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start:long,end:long>>")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated, spans)`` for every row of ``docs``.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII. A word is
    hit where it lies in an occurrence of a 13-word window of an item; an item
    of fewer words, but not none, is one window. ``contaminated``: hits are at
    least a twentieth of the words. ``spans`` are the hit stretches in word
    places. Null and empty texts have no words and no hits; repeated items count
    each; repeated documents give a row each; other columns are ignored. An
    empty benchmark hits nothing.
    """
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows equal in id and text have equal hits, so their hash may stand for them
    row = d.withColumn("row", F.xxhash64("id", "text"))
    found: list[DataFrame] = []
    held: Index | None = None
    for block in _blocks(bench, item_col, item_text, block_bytes):
        if held is not None:
            found.append(written(_found(row, sc.broadcast(held)), "hits"))
        held = Index(block)
    if found:
        # as many distinct values for a row as there are blocks, however often a document is repeated
        by = reduce(DataFrame.unionAll, found).groupBy("row").agg(F.collect_set("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        d = row.join(by, "row", "left")
    else:
        d = d.withColumns({"hits": F.array().cast("array<binary>"), "items": F.array().cast("array<string>")})
    d = _summed(d, sc.broadcast(held))
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return d.select("id", "n_words", "n_hit", "n_items", "items_sha256", flag.alias("contaminated"), "spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all ``documents``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans").withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), ks AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item_id, s, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
