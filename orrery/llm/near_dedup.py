"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

Texts with equal shingle sets are one class and are compared once. MinHash
samples of each class are banded; classes that meet in band buckets, directly or
through others, form a group. A group is cut into blocks of bounded size, and
each task compares two blocks: odd sketches (parity bitmaps of the samples,
compared by the population count of their XOR) drop pairs that cannot reach the
similarity, and the rest are counted on the whole shingle sets. A task gives back
only as many links as join what is linked, so no row is made for a pair and no
link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bytewords as B
from orrery.llm.resident import only
from orrery.llm.tables import table
from orrery.operators.graph import connected_components
from orrery.session import written

ROWS_PER_BAND = 4
#: Chance that a pair of exactly the wanted similarity shares no band.
MISS = 1e-7
SKETCH_BITS = 512
SLICE = 1 << 17  # shingles worked on at once
#: Shingles and texts of one block of a group; two blocks are compared at a time.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 1024
#: Blocks of a group beyond which its band buckets are compared one by one.
MOST_BLOCKS = 24
#: Places of texts that a broadcast may hold, and their bytes; more are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes of sets in one batch.
SENT_BYTES = 16 << 20


def bands_for(similarity: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1


def sketch_limit(similarity: float, samples: int) -> int:
    """Most differing sketch bits of a pair that has the similarity, with a chance of about 1e-10 of more.

    Each sample that differs changes at most two bits; the number of differing
    samples is binomial.
    """
    p, tail, total = 1 - similarity, 1e-10, 0.0
    logs = [math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + (d * math.log(p) if d else 0) + (samples - d) * math.log1p(-p) if p > 0 else (0.0 if d == 0 else -math.inf) for d in range(samples + 1)]
    for d in range(samples, -1, -1):
        total += math.exp(logs[d])
        if total > tail:
            return 2 * d
    return 0


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, ascending within each, and where each text's begin (n + 1 values)."""
    h, first = B.words(texts, B.SPACE)
    g, at = B.grams(h, first, k)
    doc = B.owner(at, first)
    n_words = np.diff(first)
    for short in range(1, k):
        which = np.flatnonzero(n_words == short)
        if len(which):
            g = np.concatenate([g, B.whole(h, first, which, short)])
            doc = np.concatenate([doc, which])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(n_words) + 1))


def minhashes(g: np.ndarray, begin: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) MinHash values; texts without shingles must not be among them."""
    n = len(begin) - 1
    out = np.empty((n, samples), np.uint64)
    salts = B.mix(np.arange(2 * samples, dtype=np.uint64), 7)
    a, b = salts[:samples] | np.uint64(1), salts[samples:]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE, "right")) - 1)
        part, starts = g[begin[at] : begin[to]], begin[at:to] - begin[at]
        for j in range(samples):
            out[at:to, j] = np.minimum.reduceat(part * a[j] + b[j], starts)
        at = to
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(mins), bands), np.uint64)
    for r in range(rows):
        key = key * np.uint64(B._P) + mins[:, r : bands * rows : rows]
    return B.mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F), 11)


def odd_sketches(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(texts, bits / 64) words: each sample flips one bit."""
    n, samples = mins.shape
    at = (B.mix(mins + np.arange(samples, dtype=np.uint64)[None, :] * np.uint64(0x9FB21C651E98DF25), 13) % np.uint64(bits)).astype(np.int64)
    parity = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, similarity: float, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n, set key (k1, k2) and band keys; the last is null without shingles."""
    bands = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near_dedup")
        for batch in B.slices(batches, 1):
            g, begin = shingle_sets(batch.column(1), k)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            keys = np.zeros((2, len(n)), np.uint64)
            band = pa.nulls(len(n), pa.list_(pa.int64()))
            if len(some):
                starts = np.append(begin[some], begin[-1])
                for i in (0, 1):
                    keys[i, some] = np.add.reduceat(B.mix(g, 101 + i), starts[:-1])
                mins = minhashes(g, starts, bands * ROWS_PER_BAND)
                lengths = np.zeros(len(n) + 1, np.int32)
                lengths[some + 1] = bands
                band = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(band_keys(mins, bands, ROWS_PER_BAND).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in keys), band], names)

    names = ["id", "n", "k1", "k2", "bands"]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>")


def _replicated_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (id, text, unit, block, blocks) as (unit, lo, hi, id, set): a row for each pair of blocks that the text's block is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, 1, rows=500):
            g, begin = shingle_sets(batch.column("text"), k)
            rows: list[tuple] = []
            size = 0
            for i, (x, placed) in enumerate(zip(batch.column("id").to_pylist(), batch.column("placed").to_pylist())):
                own = g[begin[i] : begin[i + 1]].tobytes()
                for p in placed:
                    for o in range(p["blocks"]):
                        rows.append((p["unit"], min(p["block"], o), max(p["block"], o), x, own))
                        size += len(own)
                        if size > SENT_BYTES or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["unit", "lo", "hi", "id", "set"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return docs.select("id", "text", "placed").mapInArrow(run, "unit long, lo int, hi int, id long, set binary")


def _near(sets: list[np.ndarray], ratio: Fraction, samples: int, limit: int) -> np.ndarray:
    """(pairs, 2) places in ``sets`` of similarity ``ratio`` or more: sketches first, then the whole sets."""
    n = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate(sets)
    sketch = odd_sketches(minhashes(flat, begin, samples))
    num, den = ratio.numerator, ratio.denominator
    out = []
    shared = dense = None
    for at in range(0, len(sets), 256):
        to = min(at + 256, len(sets))
        apart = np.zeros((to - at, len(sets)), np.uint16)
        for w in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[at:to, w, None] ^ sketch[None, :, w])
        x, y = np.nonzero((apart <= limit) & (np.minimum(n[at:to, None], n[None, :]) * den >= np.maximum(n[at:to, None], n[None, :]) * num))
        x += at
        x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        if len(x) <= 4 * (to - at):
            common = np.array([len(np.intersect1d(sets[p], sets[q], True)) for p, q in zip(x.tolist(), y.tolist())])
        else:  # many pairs: count common shingles by matrix products over those that two sets hold
            if shared is None:
                key, place, times = np.unique(flat, return_inverse=True, return_counts=True)
                column = np.cumsum(times > 1) - 1
                row = np.repeat(np.arange(len(sets)), n)
                keep = times[place] > 1
                shared = row[keep], column[place][keep]
                width = int(column[-1]) + 1
            count = np.zeros((to - at, len(sets)), np.float32)
            for c in range(0, width, 4096):
                part = (shared[1] >= c) & (shared[1] < c + 4096)
                dense = np.zeros((len(sets), min(4096, width - c)), np.float32)
                dense[shared[0][part], shared[1][part] - c] = 1
                count += dense[at:to] @ dense.T
            common = count[x - at, y].astype(np.int64)
        ok = common * den >= (n[x] + n[y] - common) * num
        out.append(np.stack([x[ok], y[ok]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _links(members: DataFrame, ratio: Fraction, samples: int, limit: int) -> DataFrame:
    """(a, b) links that join what is linked within each (unit, lo, hi), as few as do it."""

    def linked(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        rows = [x for x in dict.fromkeys(rows) if x[1]]
        if len(rows) < 2:
            return
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for p, q in _near([np.frombuffer(x, np.uint64) for _, x in rows], ratio, samples, limit).tolist():
            a, b = find(p), find(q)
            if a != b:
                root[max(a, b)] = min(a, b)
                if rows[p][0] != rows[q][0]:
                    yield rows[p][0], rows[q][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []
        only("near_dedup")
        for batch in B.slices(batches, 4, rows=500):  # the sets are bytes like texts
            for unit, lo, hi, x, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, lo, hi) != key:
                    found += linked(held)
                    key, held = (unit, lo, hi), []
                held.append((x, own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
                found = []
        found += linked(held)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    dealt = members.repartition("unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi", "id")
    return dealt.mapInArrow(run, "a long, b long")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """(unit, id, n) with the block of each member and how many blocks its unit has; a block holds about BLOCK_SHINGLES shingles or BLOCK_TEXTS texts."""
    size = placed.groupBy("unit").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    return placed.join(size, "unit").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def near_dedup(docs: DataFrame, similarity: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two texts are linked where the Jaccard similarity of their sets of ``k``-word
    shingles is ``similarity`` or more; a text of fewer words is one shingle.
    Words are lower-cased (A-Z) runs between white space. ``component_id`` is the
    smallest id reachable over links, itself included; ``kept`` is true for that
    id. Null and empty texts have no shingles and no links. Rows that share an id
    are one node, linked to what any of their texts is linked to. Other columns
    are ignored. An empty table gives an empty result.
    """
    ratio = Fraction(str(similarity))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(src, similarity, k, "id"), "signatures")
    first = F.min(F.struct("id", "bands")).alias("r")
    reps = written(sig.where("n > 0").groupBy("k1", "k2", "n").agg(first).select("k1", "k2", "n", "r.*"), "classes")

    bands = reps.select("id", "n", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("g"), F.min("id").alias("least")).where("g > 1")
    live = written(bands.join(full, "key").select("key", "id", "n", "least"), "buckets")
    met = connected_components(live.select(F.col("id").alias("a"), F.col("least").alias("b")))
    group = live.select("id", "n").distinct().join(met, F.col("id") == F.col("node"), "left")
    grouped = written(_in_blocks(group.select(F.coalesce("component", "id").alias("unit"), "id", "n")), "groups")
    # A group of too many blocks is compared bucket by bucket instead.
    giant = grouped.where(F.col("blocks") > MOST_BLOCKS).select("id").distinct()
    by_bucket = _in_blocks(live.join(giant, "id", "left_semi").select(F.xxhash64("key", F.lit("bucket")).alias("unit"), "id", "n"))
    places = grouped.where(F.col("blocks") <= MOST_BLOCKS).select("unit", "id", "block", "blocks").union(by_bucket.select("unit", "id", "block", "blocks"))
    places = written(places.groupBy("id").agg(F.collect_set(F.struct("unit", "block", "blocks")).alias("placed")), "places")
    n_places, n_units = places.agg(F.count("*"), F.coalesce(F.sum(F.size("placed")), F.lit(0))).first()
    if n_places <= BROADCAST_TEXTS and 40 * n_places + 48 * n_units <= BROADCAST_BYTES:
        places = F.broadcast(places)
    members = _replicated_sets(src.join(places, "id"), k)
    samples = bands_for(similarity) * ROWS_PER_BAND
    links = written(_links(members, ratio, samples, sketch_limit(similarity, samples)), "links")
    # rows that share an id tie their classes together
    twice = sig.where("n > 0").join(reps.select("k1", "k2", "n", F.col("id").alias("rep")), ["k1", "k2", "n"])
    comp = connected_components(links.union(twice.where("id <> rep").join(reps.select("id"), "id", "left_semi").select("id", "rep")))
    return (
        sig.join(reps.select("k1", "k2", "n", F.col("id").alias("rep")), ["k1", "k2", "n"], "left")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
        .withColumn("kept", F.col("id") == F.col("component_id"))
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near-duplicates of all ``documents`` at a similarity of 0.85."""
    return near_dedup(table(spark, sf_dir, "documents"), 0.85).withColumnRenamed("id", "doc_id")
