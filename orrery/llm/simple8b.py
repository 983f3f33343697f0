"""Token ids in Simple-8b words, written in id order and read back.

A word holds a 4-bit selector and 60 bits of values of one width. Ids are coded
in frames of 1024; a payload lists each frame's first word, so frames can be
decoded apart and all at once. A value of more than 60 bits is an escape word
and the raw value in the next word.

Payload, little-endian: magic ``S8B1``, u32 frame size, u64 ids, u64 words,
u64 first word of each frame, then the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bytewords as B
from orrery.llm.tables import table
from orrery.llm.tokens import crc32, encoder, with_end
from orrery.session import written

FRAME = 1024
#: Values and width by selector; selector 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bits of small ids.
_LENGTH = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
HEAD = np.dtype([("magic", "S4"), ("frame", "<u4"), ("ids", "<u8"), ("words", "<u8")])


def _bits(ids: np.ndarray) -> np.ndarray:
    """The bits that each id needs."""
    if len(ids) and ids.max() < len(_LENGTH):
        return _LENGTH[ids]
    need = ((ids.astype(np.float64).view(np.int64) >> 52) - 1022).clip(0).astype(np.uint8)
    for i in np.flatnonzero(ids >> np.uint64(53)).tolist():  # beyond exact doubles
        need[i] = int(ids[i]).bit_length()
    return need


def _selectors(ids: np.ndarray, frame: int) -> np.ndarray:
    """For each place the selector that holds most ids from there on within its frame."""
    n = len(ids)
    need = np.full(-(-n // frame) * frame, 255, np.uint8)
    need[:n] = _bits(ids)
    # after each frame a value that no selector holds, so that none reaches beyond
    most = np.full((len(need) // frame, frame + 1), 255, np.uint8)
    most[:, :frame] = need.reshape(-1, frame)
    most = most.reshape(-1)
    best, have = np.full(len(most), 15, np.uint8), 1  # `most` is the greatest need over `have` ids from each place
    for s in range(14, 0, -1):  # each holds more ids of fewer bits than the one before, so the last that fits is 15 less their number
        c, w = int(COUNT[s]), int(WIDTH[s])
        while have < c:
            step = min(have, c - have)
            wider = most.copy()
            rest = max(0, len(most) - step)
            np.maximum(most[:rest], most[step:], out=wider[:rest])
            most, have = wider, have + step
        best -= most <= w
    best = best.reshape(-1, frame + 1)[:, :frame].reshape(-1)[:n]
    best[need[:n] > 60] = 0
    return best


def encode(ids: np.ndarray, frame: int = FRAME) -> bytes:
    """The payload of unsigned ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    best = _selectors(ids, frame)
    at = np.arange(0, n, frame)
    ends = np.minimum(at + frame, n)
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + COUNT[best[at]]
        on = at < ends
        at, ends = at[on], ends[on]
    starts = np.flatnonzero(begins)
    sel = best[starts]
    raw = sel == 0
    slot = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(raw)])[:-1].astype(np.int64)
    words = np.zeros(len(starts) + int(raw.sum()), np.uint64)
    for s in np.unique(sel):
        i, to = starts[sel == s], slot[sel == s]
        if s == 0:
            words[to + 1] = ids[i]
            continue
        word = np.full(len(i), int(s) << 60, np.uint64)
        for j in range(int(COUNT[s]) if WIDTH[s] else 0):
            word |= ids[i + j] << np.uint64(j * int(WIDTH[s]))
        words[to] = word
    first = slot[np.searchsorted(starts, np.arange(0, n, frame))] if n else np.zeros(0, np.int64)
    head = np.array([(b"S8B1", frame, n, len(words))], HEAD)
    return head.tobytes() + first.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(payload: bytes, frames: tuple[int, int] | None = None) -> np.ndarray:
    """The ids (uint64) of a payload, or of its frames from ``frames[0]`` to before ``frames[1]``."""
    head = np.frombuffer(payload, HEAD, 1)[0]
    if head["magic"] != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    size, n = int(head["frame"]), int(head["ids"])
    n_frames = -(-n // size)
    first = np.frombuffer(payload, "<u8", n_frames, HEAD.itemsize)
    words = np.frombuffer(payload, "<u8", int(head["words"]), HEAD.itemsize + 8 * n_frames)
    if frames:
        a, b = frames
        words = words[int(first[a]) : int(first[b]) if b < n_frames else None] if a < n_frames else words[:0]
        n = max(0, min(n, b * size) - a * size)
    sel = (words >> np.uint64(60)).astype(np.int64)
    maybe = np.flatnonzero(sel == 0)
    if len(maybe):
        escape, last = [], -2
        for p in maybe.tolist():
            if p != last + 1:
                escape.append(p)
                last = p
        escape = np.array(escape)
        keep = np.ones(len(words), bool)
        keep[escape + 1] = False
        raw = words[escape + 1]
        sel, where = sel[keep], np.cumsum(keep)[escape] - 1
        words = words[keep]
    count = COUNT[sel]
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel):
        if c := int(COUNT[s]) if WIDTH[s] and s else 0:
            at, w = np.flatnonzero(sel == s), np.uint64(WIDTH[s])
            part, mask, to = words[at], np.uint64((1 << int(WIDTH[s])) - 1), begin[at]
            for j in range(c):
                out[to + j] = (part >> np.uint64(j * int(w))) & mask
    if len(maybe):
        out[begin[where]] = raw
    return out[:n]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", batch_docs: int = 512) -> DataFrame:
    """Token ids of all texts as blocks in ascending id order.

    Columns: part and block (order of the blocks), start (ids of the part before
    the block), ids and sizes (documents of the block and their token counts),
    payload. Each block is one payload of up to ``batch_docs`` documents; parts
    are ranges of ids, so order by (part, block) is order by id. Rows that share
    an id follow each other by a hash of the text, then the text. Null texts are
    empty: the end id alone. Other columns are ignored; an empty table gives no
    blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path)
        for batch in B.slices(batches, 1, batch_docs):
            flat, begin = with_end(*enc.encode(batch.column(1)), end_id)
            row = [part, block, start, batch.column(0).to_pylist(), np.diff(begin).tolist(), encode(flat)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)
            block, start = block + 1, start + len(flat)

    names = ["part", "block", "start", "ids", "sizes", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # by digest among rows that share an id, so that their order is defined and one id may fill several parts
    ranged = src.withColumn("_h", F.xxhash64("text")).repartitionByRange("id", "_h").sortWithinPartitions("id", "_h", "text").drop("_h")
    return written(ranged.mapInArrow(run, "part int, block int, start long, ids array<long>, sizes array<long>, payload binary"), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document in the blocks, decoded from them; start counts all ids before."""
    spark = blocks.sparkSession
    totals = sorted(blocks.groupBy("part").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).collect())  # a row for each file
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                flat = decode(payload).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + first), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(base), "part").select(F.col("start") + F.col("base"), "ids", "sizes", "payload")
    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token places of all ``documents``, written and read back."""
    import public_tokenizers

    blocks = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(blocks).withColumnRenamed("id", "doc_id")
