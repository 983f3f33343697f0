"""Structure, health and split-trust aggregates of record and annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def class_table(df: DataFrame, cls: str, split: str, image: str, splits: list[str]) -> DataFrame:
    """Instances and images by class, in all and in each split, most frequent classes first."""
    parts = [F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}") for s in splits]
    return df.groupBy(cls).agg(F.count("*").alias("instances"), F.countDistinct(image).alias("images"), *parts)


def size_quantiles(df: DataFrame, cls: str, value: Column, digits: int = 2) -> DataFrame:
    """Count and exact interpolated quantiles of ``value`` by class."""
    q = F.percentile(value, list(QUANTILES))
    d = df.groupBy(cls).agg(F.count(value).alias("n"), q.alias("_q"))
    return d.select(cls, "n", *(F.round(F.col("_q")[i], digits).alias(f"p{int(x * 100)}") for i, x in enumerate(QUANTILES)))


def histogram(df: DataFrame, by: str) -> DataFrame:
    """How many groups of ``by`` have each number of rows."""
    return df.groupBy(by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, x: Column, y: Column, cells: int = 40) -> DataFrame:
    """Counts of points in [0, 1] by cell; points on the far edge lie in the last cell."""
    cell = lambda v: F.least(F.greatest(F.floor(v * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    return df.groupBy(cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").alias("n"))


def long_tail(df: DataFrame, cls: str) -> DataFrame:
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), cls)))


def top_and_other(df: DataFrame, cls: str, k: int) -> DataFrame:
    """The ``k`` most frequent values and one row for the rest, named with how many there are."""
    r = long_tail(df, cls)
    other = r.where(F.col("rank") > k).agg(F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 0")
    return r.where(F.col("rank") <= k).select(F.col(cls).alias("value"), "n").union(other.select(F.concat(F.lit("other ("), F.col("c"), F.lit(")")), "n"))


def outside(df: DataFrame, width: float, height: float, slack: float = 1.0) -> DataFrame:
    """Boxes that leave the image by more than ``slack`` pixels."""
    return df.where((F.col("x1") < -slack) | (F.col("y1") < -slack) | (F.col("x1") + F.col("w") > width + slack) | (F.col("y1") + F.col("h") > height + slack))


def shared_names(df: DataFrame, path: str) -> DataFrame:
    """File names that occur in several folders, with how many."""
    d = df.select(F.substring_index(path, "/", -1).alias("name"), F.regexp_replace(path, "/?[^/]*$", "").alias("folder"))
    return d.groupBy("name").agg(F.countDistinct("folder").alias("folders")).where("folders > 1")


def exact_duplicates(df: DataFrame, key: str, content: str, order: list[str] | None = None) -> DataFrame:
    """Rows whose content an earlier row has: size is compared before any hash, so unique sizes are never hashed."""
    order = order or [key]
    sized = df.select(key, *(c for c in order if c != key), F.octet_length(content).alias("size"), F.col(content).alias("_c"))
    again = sized.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select("size")
    same = sized.join(again, "size", "left_semi").withColumn("sha1", F.sha1(F.col("_c").cast("binary"))).drop("_c")
    w = Window.partitionBy("size", "sha1").orderBy(*order)
    return same.withColumn("first", F.first(key).over(w)).where(F.col("first") != F.col(key)).select(key, "first", "size")


def class_balance(df: DataFrame, cls: str, split: str) -> DataFrame:
    """A class's share of each split against the split's share of all, in points."""
    n = df.groupBy(cls, split).agg(F.count("*").alias("n"))
    of_class = F.sum("n").over(Window.partitionBy(cls))
    totals = df.groupBy(split).agg(F.count("*").alias("s"))
    every = df.agg(F.count("*").alias("t"))
    share = n.withColumn("class_share", F.col("n") / of_class).join(F.broadcast(totals.join(F.broadcast(every)).select(split, (F.col("s") / F.col("t")).alias("split_share"))), split)
    return share.select(cls, split, "n", F.round("class_share", 6).alias("class_share"), F.round("split_share", 6).alias("split_share"), F.round(F.col("class_share") - F.col("split_share"), 6).alias("deviation"))


def missing_classes(df: DataFrame, cls: str, split: str, edges: tuple[int, ...] = (5, 20)) -> DataFrame:
    """For each split other than train: classes without records, and with fewer than each edge."""
    universe = df.select(cls).distinct().join(F.broadcast(df.where(F.col(split) != "train").select(split).distinct()))
    n = universe.join(df.groupBy(cls, split).agg(F.count("*").alias("n")), [cls, split], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.groupBy(split).agg(F.count(F.when(F.col("n") == 0, 1)).alias("none"), *(F.count(F.when(F.col("n") < e, 1)).alias(f"under_{e}") for e in edges))


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Pairs of splits that share groups: how many groups, and their rows in either."""
    n = df.groupBy(group, split).agg(F.count("*").alias("n"))
    pairs = n.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(split).alias("s"), "n"))).alias("v")).where(F.size("v") > 1)
    both = pairs.select(group, F.explode(F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["s"] > a["s"]), lambda b: F.struct(a["s"].alias("split_a"), b["s"].alias("split_b"), (a["n"] + b["n"]).alias("rows")))))).alias("p"))
    return both.groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("groups"), F.sum("p.rows").alias("rows"))


def units(df: DataFrame, component: str, split: str, cls: str) -> DataFrame:
    """Rows and independent units by class outside train, with the half-width of a share at so many units."""
    d = df.where(F.col(split) != "train").groupBy(split, cls).agg(F.count("*").alias("rows"), F.countDistinct(component).alias("units"))
    return d.withColumn("half_width", F.round(1.96 * F.sqrt(0.25 / F.col("units")), 6))


def quartile_bins(df: DataFrame, value: str, fit: Column, to: str = "bin") -> DataFrame:
    """Adds the quartile bin of ``value`` as fitted on the rows of ``fit``: how many distinct quartiles lie below it; -1 for null."""
    q = df.where(fit).agg(F.array_sort(F.array_distinct(F.percentile(value, [0.25, 0.5, 0.75]))).alias("_q"))
    inside = F.size(F.filter("_q", lambda e: e < F.col(value)))
    return df.join(F.broadcast(q)).withColumn(to, F.when(F.col(value).isNull(), -1).otherwise(inside).cast("int")).drop("_q")


def likelihood_rule(df: DataFrame, cue: str, cls: str, fit: Column) -> DataFrame:
    """One row ``balanced``: mean recall over classes of a rule fitted on ``fit`` and scored on the rest.

    Each cue value names the class with the largest share of its own fit rows that
    show it, ties to the smaller class; an unseen value names the most frequent class.
    """
    f = df.where(fit)
    size = f.groupBy(cls).agg(F.count("*").alias("_n"))
    seen = f.groupBy(cue, cls).agg(F.count("*").alias("_c")).join(size, cls)
    best = seen.groupBy(cue).agg(F.min(F.struct((-F.col("_c") / F.col("_n")).alias("s"), F.col(cls).alias("k"))).alias("_b")).select(cue, F.col("_b.k").alias("named"))
    usual = size.agg(F.min(F.struct((-F.col("_n")).alias("s"), F.col(cls).alias("k"))).alias("_u")).select(F.col("_u.k").alias("usual"))
    s = df.where(~fit).join(best, cue, "left").join(F.broadcast(usual)).withColumn("named", F.coalesce("named", "usual"))
    recall = s.groupBy(cls).agg(F.avg((F.col("named") == F.col(cls)).cast("double")).alias("recall"))
    return recall.agg(F.round(F.avg("recall"), 6).alias("balanced"))


def audit(df: DataFrame, split: str, image: str) -> DataFrame:
    """Images, annotations by kind and extremes, for each split and for all (null)."""
    return df.rollup(split).agg(
        F.countDistinct(image).alias("images"),
        F.count("*").alias("annotations"),
        F.count(F.when(F.col("kind") == "det", 1)).alias("det"),
        F.count(F.when(F.col("kind") == "seg", 1)).alias("seg"),
        F.round(F.min("score"), 6).alias("min_score"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.max("score"), 6).alias("max_score"),
    )


# health


def zero_area(df: DataFrame) -> DataFrame:
    return df.where("w <= 0 or h <= 0")


def unannotated(records: DataFrame, anns: DataFrame, record: str) -> DataFrame:
    return records.join(anns.select(record).distinct(), record, "left_anti")


def unreadable(records: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    return records.where(F.col(width).isNull() | F.col(height).isNull() | (F.col(width) <= 0) | (F.col(height) <= 0))


def health(checks: dict[str, DataFrame], examples: int = 10) -> DataFrame:
    """``(check, count, examples)``: distinct paths (the one column of each table) that fail a check, and the first few of them."""
    from functools import reduce

    rows = []
    for name, d in checks.items():
        paths = d.toDF("path").distinct()
        some = paths.orderBy("path").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("examples"))
        n = paths.agg(F.count("*").alias("count"))
        rows.append(n.join(F.broadcast(some)).select(F.lit(name).alias("check"), "count", "examples"))
    return reduce(DataFrame.unionAll, rows)


def class_universe(declared: list[str], observed: DataFrame, cls: str) -> DataFrame:
    """``(class)``: names that are declared or occur."""
    spark = observed.sparkSession
    return spark.createDataFrame([(c,) for c in declared], "class string").union(observed.select(F.col(cls).alias("class")).where("class is not null")).distinct()


def missing_names(df: DataFrame, cls: str, split: str, sep: str = ";") -> DataFrame:
    """``(split, classes, names)``: for each split other than train, the classes that it lacks."""
    universe = df.select(cls).where(F.col(cls).isNotNull()).distinct().join(F.broadcast(df.where(F.col(split) != "train").select(split).distinct()))
    gone = universe.join(df.select(cls, split).distinct(), [cls, split], "left_anti")
    return gone.groupBy(split).agg(F.count("*").alias("classes"), F.array_join(F.array_sort(F.collect_list(cls)), sep).alias("names"))


def aspect_histogram(df: DataFrame, w: Column, h: Column, edges: list[float]) -> DataFrame:
    """``(bin, n)``: how many values of w / h lie below the first edge (0), between edges, and from the last on."""
    ratio = w / h
    b = F.lit(0)
    for e in edges:
        b = b + F.when(ratio >= e, 1).otherwise(0)
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def resolutions(df: DataFrame, w: str, h: str, top: int = 20) -> DataFrame:
    """``(value, n)``: the most frequent sizes and one row for the rest."""
    return top_and_other(df.select(F.concat_ws("x", F.col(w).cast("string"), F.col(h).cast("string")).alias("size")), "size", top)
