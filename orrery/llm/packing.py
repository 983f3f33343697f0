"""Best-fit packing by large-item matching.

Only how many pieces there are of each length decides the packing, so the
driver plans on that histogram: a row for each length up to the capacity,
however many documents there are. Pieces above a third of the capacity pair at
most twice in a bin by greedy matching, largest first with the largest that
fits; smaller pieces go, largest first, where the least gap holds them. The plan
is a list of slots (length, from which rank on, sequence, offset), and each
piece finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import bytewords as B
from orrery.llm.tables import table
from orrery.llm.tokens import crc32, encoder, with_end
from orrery.session import written


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Slots (length, first rank, first sequence, offset): the piece of rank ``first + i`` lies in sequence ``first + i`` of the slot."""
    left = dict(counts)
    rank: dict[int, int] = defaultdict(int)
    slots: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    used = 0

    def put(length: int, n: int, seq: int, offset: int) -> None:
        slots.append((length, rank[length], seq, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, used, 0)
            if b is not None:
                put(b, n, used, a)
            gaps[capacity - a - (b or 0)].append((used, n))
            used += n
    for a in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[a]:
            gap = min((g for g, x in gaps.items() if g >= a and x), default=None)
            if gap is None:
                each = capacity // a
                gaps[capacity].append((used, -(-left[a] // each)))
                used += -(-left[a] // each)
                gap = capacity
            seq, n = gaps[gap].pop()
            each = min(gap // a, left[a])
            took = min(n, left[a] // each)
            if took < n:
                gaps[gap].append((seq + took, n - took))
            for i in range(each):
                put(a, took, seq, capacity - gap + i * a)
            gaps[gap - each * a].append((seq, took))
    return slots


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", batch_docs: int = 1000) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, nth)``: nth counts the pieces of the length in the part before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer_path)
        for batch in B.slices(batches, 1, batch_docs, size=1 << 20):
            flat, begin = with_end(*enc.encode(batch.column(1)), end_id)
            size = np.diff(begin)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            crc = [crc32(flat[a : a + b]) for a, b in zip((begin[doc] + start).tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            run_at = np.concatenate([[True], np.diff(length[order]) != 0])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(run_at, np.arange(len(order)), 0))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)],
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(src.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for every piece of every document.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are
    cut, into pieces of that length and a rest. Null and empty texts are the end
    id alone. Repeated rows are packed each; an empty table gives no rows.
    """
    found = pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    by_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {x.length: x.n for x in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = sorted(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = found.sparkSession.sparkContext.broadcast((np.array([x[0] << 44 | x[1] for x in slots], np.int64), np.array([x[1:] for x in slots], np.int64).reshape(-1, 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slot = keys.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            mine = slot[np.searchsorted(key, length << 44 | rank, "right") - 1]
            cols = [batch.column(c) for c in out[:5]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(mine[:, 1] + rank - mine[:, 0]), pa.array(mine[:, 2])], out)

    out = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = found.join(base, ["part", "length"]).select(*out[:5], (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all ``documents``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0).withColumnRenamed("id", "doc_id")
