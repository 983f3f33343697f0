"""Packed 64-bit hashes: range and nearest-neighbour joins, and sequential deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.arrange import with_rank
from orrery.operators.graph import connected_components
from orrery.session import dropped, written

BITS = 64
#: Largest distance whose bands still select; beyond, blocks of at most about so many hashes are compared.
BANDED, BLOCK = 10, 32_768
#: Pairs that numpy compares at once, which a core's cache holds, and rows of a batch that a task gives back.
TILE, OUT = 1 << 17, 1 << 16
#: Hashes that a round of sequential deduplication settles.
ROUND = 32_768


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _parts(n: int, least: int) -> int:
    """Blocks of ``n`` hashes: enough for the cores, and none above ``BLOCK`` but by chance."""
    return max(1, min(least, -(-n // 512)), -(-n // BLOCK))


def _met(rows: DataFrame, bands: int, pick: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``pick`` of each band's rows (band, side, id, h, ...), which meet in one task by side, then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            band = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
            for x, y in zip(cuts, cuts[1:]):
                if y == x:
                    continue
                if held and band[x] != at:
                    yield from pick(at, pa.Table.from_batches(held))
                    held = []
                at = int(band[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from pick(at, pa.Table.from_batches(held))

    return rows.repartition(min(bands, 10_000), "band").sortWithinPartitions("band", "side", "id").mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    n = int(np.searchsorted(t.column("side").to_numpy(), 1))
    a, b = t.slice(0, n), t.slice(n)
    bits = lambda x: x.column("h").to_numpy().view(np.uint64)
    return a, b, bits(a), bits(b)


def _hits(a: np.ndarray, b: np.ndarray, limit: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dist) of all a[i], b[j] at most ``limit`` bits apart, piece by piece; of one set with itself those with i < j."""
    step = max(1, TILE // max(1, len(b)))
    for x in range(0, len(a), step):
        first = x + 1 if same else 0
        rest = b[first:]
        if not len(rest):
            continue
        d = np.bitwise_count(a[x : x + step, None] ^ rest[None, :])
        at = np.flatnonzero(d <= limit)
        if len(at):
            i, j = np.divmod(at, len(rest))
            i, j, d = i + x, j + first, d.ravel()[at]
            if same:
                up = i < j
                i, j, d = i[up], j[up], d[up]
            yield i, j, d


def _by_blocks(d: DataFrame, pick: Callable[[bool, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``pick`` of every two blocks, and of each with itself, of different hashes ``d`` (id, h, n)."""
    d = written(d, "hashes")
    m = _parts(d.count(), 8)
    block = F.pmod(F.xxhash64("h"), F.lit(m))
    e = d.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    e = e.select((F.least("block", "o") * m + F.greatest("block", "o")).cast("long").alias("band"), (F.col("block") > F.col("o")).cast("int").alias("side"), "id", "h", "n")
    return _met(e, m * (m + 1) // 2, lambda band, t: pick(band // m == band % m, t), schema)


def _distinct(df: DataFrame, key: str, h: str) -> DataFrame:
    """``(h, id, n)``: each hash, its first row, and how many rows have it."""
    return df.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(key).alias("id"), F.count("*").alias("n"))


def members(df: DataFrame, key: str, h: str) -> DataFrame:
    """``(id, a)``: each row and the first row of its hash, which stands for all that are equal."""
    first = df.groupBy(F.col(h).alias("h")).agg(F.min(key).alias("a"))
    return df.select(F.col(key).alias("id"), F.col(h).alias("h")).join(first, "h").select("id", "a")


def pairs_within(df: DataFrame, key: str, h: str, limit: int) -> DataFrame:
    """``(a, b, dist, n_a, n_b)`` with a < b: different hashes at most ``limit`` bits apart, each by its first row, and how many rows have them.

    Equal hashes are one, so no hash meets itself. Hashes that close agree on one of
    limit + 1 bands, so small limits are an exact equi-join of bands. For wide
    limits, where bands select nothing, all hashes are compared by blocks, whose
    number follows theirs.
    """
    d = _distinct(df, key, h)
    if limit > BANDED:
        kind = dict(d.dtypes)["id"]

        def near(same: bool, t: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b, ha, hb = _sides(t)
            if same:
                b, hb = a, ha
            ia, ib = (x.column("id").combine_chunks() for x in (a, b))
            oa, ob = (x.to_numpy(zero_copy_only=False) for x in (ia, ib))
            na, nb = (x.column("n").to_numpy() for x in (a, b))
            names = ["a", "b", "dist", "n_a", "n_b"]
            ids = pa.concat_arrays([ia, ib])
            for i, j, dist in _hits(ha, hb, limit, same):
                for x in range(0, len(i), OUT):
                    p, q, r = i[x : x + OUT], j[x : x + OUT], dist[x : x + OUT]
                    up = (oa[p] < ob[q]).astype(bool)
                    q_ = q + len(oa)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(up, p, q_))), ids.take(pa.array(np.where(up, q_, p))), pa.array(r.astype(np.int32)), pa.array(np.where(up, na[p], nb[q])), pa.array(np.where(up, nb[q], na[p]))], names)

        return _by_blocks(d, near, f"a {kind}, b {kind}, dist int, n_a long, n_b long")
    n = limit + 1
    edge = [BITS * i // n for i in range(n + 1)]
    mask = lambda i: (1 << (edge[i + 1] - edge[i])) - 1
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", edge[i]).bitwiseAND(mask(i) if mask(i) < 2**63 else -1).alias("v")) for i in range(n)))
    e = d.withColumn("band", F.explode(bands))
    l, r = e.select("band", F.col("id").alias("a"), F.col("h").alias("ha"), F.col("n").alias("n_a")), e.select("band", F.col("id").alias("b"), F.col("h").alias("hb"), F.col("n").alias("n_b"))
    near = l.join(r, "band").where("a < b").withColumn("dist", _apart("ha", "hb").cast("int")).where(F.col("dist") <= limit)
    return near.select("a", "b", "dist", "n_a", "n_b").distinct()


def links_within(df: DataFrame, key: str, h: str, limit: int) -> DataFrame:
    """``(a, b)``: pairs of ``pairs_within``, or for wide limits as few of them as connect the same rows within every two blocks."""
    if limit <= BANDED:
        return pairs_within(df, key, h, limit).select("a", "b")
    d = _distinct(df, key, h)
    kind = dict(d.dtypes)["id"]

    def tree(same: bool, t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, ha, hb = _sides(t)
        if same:
            b, hb = a.slice(0, 0), ha
        ids = pa.concat_arrays([x.column("id").combine_chunks() for x in (a, b)])
        root = np.arange(len(ids))
        for i, j, _ in _hits(ha, hb, limit, same):
            j = j if same else j + len(ha)
            while len(i):
                x, y = root[i], root[j]
                open_ = x != y
                i, j, x, y = i[open_], j[open_], x[open_], y[open_]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := root[root], root):
                    root = up
        at = np.flatnonzero(root != np.arange(len(root)))
        if len(at):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(root[at]))], ["a", "b"])

    return _by_blocks(d, tree, f"a {kind}, b {kind}")


def nearest(query: DataFrame, ref: DataFrame, key: str, h: str, k: int = 1) -> DataFrame:
    """(q, r, dist, rank): the ``k`` nearest references of each query, ties by reference id.

    Blocks of queries meet blocks of references, a task each, which keeps the best
    ``k`` of every query. Without a hash nothing is near: such references come
    last, and such queries get the first ones, at no known distance.
    """
    side = lambda d, s: d.select(F.lit(s).alias("side"), F.col(key).alias("id"), F.col(h).alias("h"))
    q, r = side(query, 0), side(ref, 1)
    known = F.col("h").isNotNull()
    n_q, n_r = (_parts(x.where(known).count(), least) for x, least in ((q, 4), (r, 8)))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    bands = q.where(known).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1)))).select((number(n_q) * n_r + F.col("o")).cast("long").alias("band"), "side", "id", "h")
    bands = bands.unionAll(r.where(known).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select((F.col("o") * n_r + number(n_r)).cast("long").alias("band"), "side", "id", "h"))
    types = dict(bands.dtypes)["id"]
    far = np.int64(127 << 32)

    def closest(band: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, ha, hb = _sides(t)
        if not (len(ha) and len(hb)):
            return
        best = np.full((len(ha), k), far)
        wide = 4096
        step = TILE // wide
        for x in range(0, len(ha), step):
            own, mine = ha[x : x + step, None], best[x : x + step]
            for y in range(0, len(hb), wide):
                d = np.bitwise_count(own ^ hb[None, y : y + wide])
                rows = np.flatnonzero(d.min(axis=1) < mine[:, -1] >> 32)  # of equals the first stays
                if len(rows):
                    got = (d[rows].astype(np.int64) << 32) + np.arange(y, y + d.shape[1])
                    if k < got.shape[1]:
                        got = np.partition(got, k - 1, axis=1)[:, :k]
                    mine[rows] = np.sort(np.concatenate([mine[rows], got], axis=1), axis=1)[:, :k]
        i, j = np.nonzero(best < far)
        v = best[i, j]
        take = lambda x, at: x.column("id").combine_chunks().take(pa.array(at))
        yield pa.RecordBatch.from_arrays([take(a, i), take(b, v & 0xFFFFFFFF), pa.array((v >> 32).astype(np.int32))], ["q", "r", "dist"])

    d = _met(bands, n_q * n_r, closest, f"q {types}, r {types}, dist int")
    beside = lambda a, b: a.select(F.col("id").alias("q")).crossJoin(F.broadcast(b.orderBy("id").limit(k).select(F.col("id").alias("r")))).withColumn("dist", F.lit(None).cast("int"))
    d = d.unionAll(beside(q.where(known), r.where(~known))).unionAll(beside(q.where(~known), r))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.asc_nulls_last("dist"), "r"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "r", "dist", "rank")


def similarity_components(df: DataFrame, key: str, h: str, limit: int) -> DataFrame:
    """(id, component) for every row, by hashes at most ``limit`` bits apart; a null hash is near to none."""
    first = written(members(df, key, h), "members")
    comp = connected_components(links_within(df, key, h, limit))
    d = df.select(F.col(key).alias("id")).join(first, "id", "left").join(comp, F.col("a") == F.col("node"), "left")
    return d.select("id", F.coalesce("component", "a", "id").alias("component"))


def _kept_in_rounds(first: DataFrame, limit: int) -> DataFrame:
    """``id`` of the hashes (id, h, n) that stay, ``ROUND`` at a time in order of id: what an earlier kept one is near to goes, and one task settles the rest of the round."""
    d = written(with_rank(first.withColumn("side", F.lit(0)), ["id"], "at"), "ordered")

    def gone(band: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, _, ha, hb = _sides(t)
        hit = np.zeros(len(ha), bool)
        step = max(1, TILE // max(1, len(hb)))
        for x in range(0, len(ha) if len(hb) else 0, step):
            hit[x : x + step] = np.bitwise_count(ha[x : x + step, None] ^ hb[None, :]).min(axis=1) <= limit
        yield pa.RecordBatch.from_arrays([a.column("id").combine_chunks().take(pa.array(np.flatnonzero(hit)))], ["id"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]  # a round at most
        if held:
            t = pa.Table.from_batches(held)
            bits = t.column("h").to_numpy().view(np.uint64)
            stay = np.ones(len(bits), bool)
            for i in range(len(bits)):
                if stay[i]:
                    stay[i + 1 :] &= np.bitwise_count(bits[i + 1 :] ^ bits[i]) > limit
            yield from t.filter(pa.array(stay)).to_batches()

    kind, n, kept, n_kept = dict(first.dtypes)["id"], d.count(), [], 0
    for x in range(0, max(n, 1), ROUND):
        rows = d.where((F.col("at") >= x) & (F.col("at") < x + ROUND)).select("side", "id", "h")
        if kept:
            before = reduce(DataFrame.unionAll, kept).withColumn("side", F.lit(1))
            m_a, m_b = _parts(ROUND, 8), _parts(n_kept, 2)
            over = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
            bands = rows.withColumn("o", over(m_b)).select((own(m_a) * m_b + F.col("o")).cast("long").alias("band"), "side", "id", "h")
            bands = bands.unionAll(before.withColumn("o", over(m_a)).select((F.col("o") * m_b + own(m_b)).cast("long").alias("band"), "side", "id", "h"))
            rows = rows.join(_met(bands, m_a * m_b, gone, f"id {kind}"), "id", "left_anti")
        kept.append(written(rows.select("id", "h").repartition(1).sortWithinPartitions("id").mapInArrow(settle, f"id {kind}, h long"), "kept"))
        n_kept += kept[-1].count()
    return reduce(DataFrame.unionAll, kept).select("id")


def sequential_dedup(df: DataFrame, key: str, h: str, limit: int) -> DataFrame:
    """Rows kept when taken in order of ``key``: a row goes if an earlier kept one is at most ``limit`` bits away; rows without a hash stay.

    Of equal hashes only the first can stay. Whether it stays depends on earlier
    decisions. For wide limits rounds take the hashes in order, ``ROUND`` at a
    time. For small ones rounds settle all whose earlier neighbours are settled:
    one with a kept neighbour goes, one whose neighbours all went stays; there are
    as many rounds as the longest chain of neighbours is long.
    """
    if limit > BANDED:
        stay = df.join(_kept_in_rounds(_distinct(df, key, h), limit).select(F.col("id").alias(key)), key, "left_semi")
        return stay.unionByName(df.where(F.col(h).isNull()))
    first = df.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(key).alias("id"))
    pairs = written(pairs_within(df, key, h, limit).select("a", "b"), "near")
    state = written(first.select("id", F.lit(None).cast("boolean").alias("kept")), "settled")
    while not state.where("kept is null").isEmpty():
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("k", F.lit(False))).alias("any_kept"), F.max(F.col("k").isNull()).alias("any_open"))
        now = state.join(before, "id", "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), False).when(F.coalesce("any_open", F.lit(False)), None).otherwise(True)
        last, state = state, written(now.select("id", kept.alias("kept")), "settled")
        dropped(last)
    stay = df.join(state.where("kept").select(F.col("id").alias(key)), key, "left_semi")
    return stay.unionByName(df.where(F.col(h).isNull()))
