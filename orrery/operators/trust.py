"""Whether a split can be trusted: twins, shuffled baselines, cues and what they give away, examples and extremes."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import profile, sampling, similarity
from orrery.operators.arrange import with_rank
from orrery.session import written

#: Positions, in percent of the ranking, whose rows serve as examples.
EXAMPLES = (0, 1, 5, 25, 75)


def twins(query: DataFrame, ref: DataFrame, key: str, h: str) -> DataFrame:
    """``(q, r, score)``: the closest reference of each query, and how many of 64 bits they share."""
    near = similarity.nearest(query, ref, key, h, 1)
    return near.select("q", "r", (F.lit(similarity.BITS) - F.col("dist")).alias("score"))


def rank_curve(scores: DataFrame, key: str = "q", score: str = "score") -> DataFrame:
    """``scores`` with ``rank`` (from 0, best first, ties by key) and ``percent``, the position from 0 to 100.

    Positions count rows, so ties do not share one.
    """
    scores = written(scores, "scores")
    d = with_rank(scores.withColumn("_down", -F.col(score)), ["_down", key], "rank").drop("_down")
    n = scores.agg(F.count("*").alias("_n"))
    return d.join(F.broadcast(n)).withColumn("percent", F.when(F.col("_n") > 1, 100.0 * F.col("rank") / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def at_percents(ranked: DataFrame, percents: tuple[int, ...] = EXAMPLES) -> DataFrame:
    """The rows of a rank curve at some percents, rounded half to even; a row at several has the first."""
    n = ranked.agg(F.count("*").alias("_n"))
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), F.bround(F.lit(p / 100) * (F.col("_n") - 1)).cast("long").alias("at")) for p in percents))
    d = ranked.join(F.broadcast(n)).withColumn("example", F.get(F.filter(wanted, lambda w: w["at"] == F.col("rank")), 0)["p"])
    return d.where("example is not null").drop("_n")


def share_at(scores: DataFrame, floor: float, score: str = "score") -> DataFrame:
    """One row: the share of scores from ``floor`` on, and how many there are."""
    return scores.agg(F.coalesce(F.avg((F.col(score) >= floor).cast("double")), F.lit(0.0)).alias("share"), F.count("*").alias("n"))


def shuffled_split(df: DataFrame, key: str, split: str, seed: int = 0) -> DataFrame:
    """``df`` with the splits dealt anew by hash of the key, each as large as before."""
    ranked = with_rank(df.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), ["_h", key], "_at").drop("_h")
    n = df.groupBy(split).agg(F.count("*").alias("_n"))
    upto = n.select(F.col(split).alias("_s"), F.sum("_n").over(Window.orderBy(split)).alias("_to"), (F.sum("_n").over(Window.orderBy(split)) - F.col("_n")).alias("_from"))  # a row for each split
    return ranked.join(F.broadcast(upto), (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).withColumn(split, F.col("_s")).drop("_s", "_from", "_to", "_at")


def baseline(df: DataFrame, key: str, h: str, split: str, floor: float, seed: int = 0) -> DataFrame:
    """``share_at`` of each split other than train against train, where splits are dealt at random."""
    d = shuffled_split(df, key, split, seed)
    train = d.where(F.col(split) == "train")
    names = sorted(r[0] for r in df.where(F.col(split) != "train").select(split).distinct().collect())
    parts = [share_at(twins(d.where(F.col(split) == s), train, key, h), floor).select(F.lit(s).alias(split), "share", "n") for s in names]
    return reduce(DataFrame.unionAll, parts)


# cues


def file_index(df: DataFrame, path: str, to: str = "file_index") -> DataFrame:
    """Adds the place, from 0, of each file by its stem, then its path."""
    d = df.withColumn("_stem", F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))
    return with_rank(d, ["_stem", path], to).drop("_stem")


def category_bins(df: DataFrame, cue: str, fit: Column, to: str = "bin") -> DataFrame:
    """Adds ``to``: the place of a value among those of the fit rows, the most frequent first (ties by value), from 1; 0 for a value they never show. Null is the value ``none``."""
    v = F.coalesce(F.col(cue).cast("string"), F.lit("none"))
    seen = df.where(fit).groupBy(v.alias("_v")).agg(F.count("*").alias("_n"))
    named = with_rank(seen.withColumn("_down", -F.col("_n")), ["_down", "_v"], "_at").select("_v", (F.col("_at") + 1).alias("_b"))
    return df.withColumn("_v", v).join(named, "_v", "left").withColumn(to, F.coalesce("_b", F.lit(0)).cast("int")).drop("_v", "_b")


def joint(df: DataFrame, bins: list[str], to: str) -> DataFrame:
    """Adds ``to``: several cues' bins as one value."""
    return df.withColumn(to, F.concat_ws("|", *(F.col(b).cast("string") for b in bins)))


def shuffled_floor(df: DataFrame, cue: str, cls: str, key: str, fit: Column, shuffles: int = 20, seed: int = 0) -> DataFrame:
    """One row ``floor``: mean balanced accuracy of the likelihood rule when the fit rows' classes change places by hash."""
    f, rest = df.where(fit), df.where(~fit)
    runs = []
    for i in range(shuffles):
        by = lambda s: F.sha1(F.concat(F.lit(f"{seed}:{i}:{s}:"), F.col(key).cast("string")))  # noqa: E731, B023
        places = with_rank(f.withColumn("_h", by("a")), ["_h", key], "_at").drop("_h", cls)
        classes = with_rank(f.select(key, cls).withColumn("_h", by("b")), ["_h", key], "_at").select("_at", cls)
        mixed = places.join(classes, "_at").drop("_at").withColumn("_fit", F.lit(True))
        runs.append(profile.likelihood_rule(mixed.unionByName(rest.withColumn("_fit", F.lit(False))), cue, cls, F.col("_fit")))
    return reduce(DataFrame.unionAll, runs).agg(F.round(F.avg("balanced"), 6).alias("floor"))


def forward_selection(df: DataFrame, cues: list[str], cls: str, fit: Column, steps: int | None = None) -> list[tuple[int, str, float]]:
    """(step, cue, accuracy): cues in the order in which each adds most to the balanced accuracy of all so far together; ties to the first named."""
    chosen: list[str] = []
    out = []
    d = df.select(cls, fit.alias("_fit"), *cues).persist()
    try:
        while len(chosen) < min(len(cues), steps or len(cues)):
            best: tuple[float, str] | None = None
            for cue in (c for c in cues if c not in chosen):
                got = profile.likelihood_rule(joint(d, [*chosen, cue], "_joint"), "_joint", cls, F.col("_fit")).first().balanced
                if best is None or got > best[0]:
                    best = (got, cue)
            chosen.append(best[1])
            out.append((len(chosen), best[1], float(best[0])))
    finally:
        d.unpersist()
    return out


# examples


def class_examples(df: DataFrame, cls: str, key: str, top: int = 20, each: int = 12, seed: int = 0) -> DataFrame:
    """Rows of the largest and the rarest classes, ``each`` sampled of every one."""
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    most = n.orderBy(F.desc("_n"), cls).limit(top).unionAll(n.orderBy("_n", F.desc(cls)).limit(top)).select(cls).distinct()
    return sampling.take(df.join(F.broadcast(most), cls), key, each, seed, by=[cls])


def extremes(df: DataFrame, size: str, path: str, n: int = 6) -> DataFrame:
    """``df`` with ``extreme``: the ``n`` largest and smallest by ``size``, ties by path (the largest by descending path); rows without a size are neither."""
    d = df.where(F.col(size).isNotNull())
    low = d.orderBy(size, path).limit(n).withColumn("extreme", F.lit("smallest"))
    return d.orderBy(F.desc(size), F.desc(path)).limit(n).withColumn("extreme", F.lit("largest")).unionAll(low)


def with_replacement(df: DataFrame, key: str, cls: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Draws of each class, as many as its target: the n-th draw is the row at a place by hash, so rows may come several times."""
    ranked = df.withColumn("_at", F.row_number().over(Window.partitionBy(cls).orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)) - 1)
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    draws = targets.join(n, cls).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("target").cast("int"))))
    h = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(cls).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.select(cls, "draw", (h % F.col("_n")).cast("int").alias("_at")).join(ranked, [cls, "_at"]).drop("_at")


def rng(seed: int, key: str) -> random.Random:
    """A generator of its own for each key, whatever the partition."""
    return random.Random(f"{seed}:{key}")
