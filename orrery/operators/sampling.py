"""Nested hash sampling: ranks by sha1 of seed and key, so a larger sample holds every smaller one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: Column, seed: int, by: list[str]) -> Column:
    """Place by sha1 of ``seed:key`` within ``by``, from 1."""
    w = Window.partitionBy(*by).orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), key)), key)
    return F.row_number().over(w)


def take(df: DataFrame, key: str, k: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """The ``k`` rows of lowest rank, in each stratum if ``by`` is given.

    Without strata this is a bounded top-k that no single task sorts; with strata
    the window keeps k rows of a group before the shuffle.
    """
    if not by:
        return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(k)
    return df.withColumn("_r", hash_rank(F.col(key).cast("string"), seed, by)).where(F.col("_r") <= k).drop("_r")


def check_unique(df: DataFrame, key: str) -> None:
    """Ranks need keys that differ; repeated ones fail with a few of them."""
    twice = [str(r[0]) for r in df.groupBy(key).count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"sampling keys repeat, for example: {', '.join(twice)}")


def check_sizes(df: DataFrame, count: int, by: list[str] | None = None) -> None:
    """Every stratum must hold ``count`` rows."""
    if count < 0:
        raise ValueError("a count cannot be negative")
    least = df.groupBy(*(by or [])).agg(F.count("*").alias("n")).orderBy("n").first()
    if least is None or least["n"] < count:
        raise ValueError(f"{count} wanted, {least['n'] if least else 0} there")


def lowest(df: DataFrame, key: str, targets: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """Of each stratum the ``_k`` rows (a column of ``targets``) of lowest rank.

    Counts by the hash's first digits tell from where on no row can be wanted, so
    only about as many rows as are wanted are sorted.
    """
    h = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    first = F.substring("_h", 1, 4)
    d = df.withColumn("_h", h)
    n = d.groupBy(*by, first.alias("_p")).agg(F.count("*").alias("_n"))  # at most 65,536 rows a stratum
    upto = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n"))
    joined = upto.join(targets, by) if by else upto.join(F.broadcast(targets))
    cut = joined.where("_before < _k").groupBy(*by, "_k").agg(F.max("_p").alias("_cut"))
    kept = (d.join(cut, by) if by else d.join(F.broadcast(cut))).where(first <= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h", F.col(key).cast("string")))
    return kept.withColumn("_r", rank).where("_r <= _k").drop("_r", "_k", "_h", "_cut")


def take_share(df: DataFrame, key: str, share: float, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """The floor of ``share`` of each stratum, one at least for a positive share."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    k = F.floor(F.count("*") * F.lit(share))
    sizes = df.groupBy(*(by or [])).agg((F.greatest(F.lit(1), k) if share > 0 else k).alias("_k"))
    return lowest(df, key, sizes, by or [], seed)


def class_targets(df: DataFrame, cls: str, mode: str, max_n: int | None = None, max_frac: float | None = None) -> DataFrame:
    """(class, target): ``preserve`` keeps the classes' proportions, ``balance`` levels them."""
    sizes = df.groupBy(cls).agg(F.count("*").alias("n"))
    bound = sizes.agg(F.max("n").alias("most"), F.min("n").alias("fewest"))
    s = sizes.join(F.broadcast(bound))
    if mode == "preserve":
        t = F.floor(F.col("n") * max_n / F.col("most")) if max_n is not None else F.floor(F.col("n") * max_frac)
        t = F.greatest(F.lit(1), t)
    else:
        t = F.lit(max_n) if max_n is not None else F.greatest(F.lit(1), F.floor(F.col("fewest") * max_frac))
    return s.select(cls, F.least(t, F.col("n")).cast("long").alias("target"))


def class_sample(df: DataFrame, key: str, cls: str, mode: str, max_n: int | None = None, max_frac: float | None = None, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Rows of each class up to its target, in each stratum if ``by`` is given."""
    if by:
        from functools import reduce

        strata = [r for r in df.select(*by).distinct().orderBy(*by).collect()]  # a row for each stratum
        parts = []
        for r in strata:
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(r[c])) for c in by))
            parts.append(class_sample(df.where(same), key, cls, mode, max_n, max_frac, seed))
        return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)
    targets = class_targets(df, cls, mode, max_n, max_frac).select(cls, F.col("target").alias("_k"))
    return lowest(df, key, targets, [cls], seed)
