"""Selecting annotations and records, and rewriting class lists.

Annotations are one row each: record_id, ann (place within the record), kind
(det, seg, pose), cls, label, and a box or points. Records are one row each.
Rules are checked when a function is called; what depends on rows is checked by
an aggregate that fails with examples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-3
EXAMPLES = 5


def require(df: DataFrame, missing: Column, show: str, what: str) -> None:
    """Fails if ``missing`` holds for any row, with how many and a few examples of ``show``."""
    bad = df.where(missing)
    some = [str(r[0]) for r in bad.select(show).limit(EXAMPLES).collect()]
    if some:
        raise ValueError(f"{what} for {bad.count()} rows, for example: {', '.join(some)}")


def resolved(df: DataFrame, key: Column, path: str, spec: str, to: str = "key") -> DataFrame:
    """``df`` with the key; a row whose key is null fails with the paths of a few."""
    d = df.withColumn(to, key.cast("string"))
    require(d, F.col(to).isNull(), path, f"key {spec} does not resolve")
    return d


def without_names(records: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Records whose path matches none of the patterns."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.col(path).rlike(p)
    return records.where(keep)


def in_splits(records: DataFrame, split: str, wanted: list[str], prefix: bool = False) -> DataFrame:
    """Records of some splits, or of splits that begin so (``train`` meets ``train2014``); none at all fails with those there are."""
    s = F.lower(F.coalesce(F.nullif(F.col(split), F.lit("")), F.lit("train")))
    hit = F.lit(False)
    for w in wanted:
        hit = hit | (s.startswith(w.lower()) if prefix else s == w.lower())
    out = records.where(hit)
    if out.isEmpty():
        there = sorted(str(r[0]) for r in records.select(F.coalesce(F.nullif(F.col(split), F.lit("")), F.lit("train"))).distinct().limit(50).collect())
        raise ValueError(f"no records in {', '.join(wanted)}; there are: {', '.join(there) or 'none'}")
    return out


def with_kinds(records: DataFrame, anns: DataFrame, kinds: list[str], record: str = "record_id") -> DataFrame:
    """Records with an annotation of one of the kinds."""
    return records.join(anns.where(F.col("kind").isin(kinds)).select(record).distinct(), record, "left_semi")


def extent(points: Column) -> Column:
    """Struct x1, y1, x2, y2 of a ring of (x, y)*."""
    at = lambda k: F.filter(points, lambda x, i: i % 2 == k)
    return F.struct(F.array_min(at(0)).alias("x1"), F.array_min(at(1)).alias("y1"), F.array_max(at(0)).alias("x2"), F.array_max(at(1)).alias("y2"))


def paired_poses(boxes: DataFrame, keypoints: DataFrame, record: str = "record_id") -> DataFrame:
    """Pose boxes with the keypoint set of the same place among the record's sets; a record with unequal counts fails.

    Removing a paired row removes the box and its keypoints.
    """
    from pyspark.sql import Window

    def placed(d: DataFrame) -> DataFrame:
        return d.withColumn("_at", F.row_number().over(Window.partitionBy(record).orderBy("ann")))

    b, k = placed(boxes), placed(keypoints.select(record, "ann", F.col("points").alias("keypoints")))
    n = b.groupBy(record).agg(F.count("*").alias("_b")).join(k.groupBy(record).agg(F.count("*").alias("_k")), record, "full")
    require(n, ~F.col("_b").eqNullSafe(F.col("_k")), record, "pose boxes and keypoint sets do not pair")
    return b.join(k.drop("ann"), [record, "_at"]).drop("_at")


def same_points(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two arrays of numbers have one length and differ by at most ``tolerance`` each."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)


def drop_shapes(shapes: DataFrame, removed: DataFrame, record: str = "record_id") -> DataFrame:
    """Shapes (record, shape_type, points) without those that equal a removed one (record, shape_type, points) within the tolerance."""
    gone = removed.groupBy(record).agg(F.collect_list(F.struct("shape_type", "points")).alias("_gone"))  # one record's removals
    hit = F.exists(F.coalesce("_gone", F.array().cast(gone.schema["_gone"].dataType)), lambda g: (g["shape_type"] == F.col("shape_type")) & same_points(g["points"], F.col("points")))
    return shapes.join(gone, record, "left").where(~hit).drop("_gone")


def emptied(before: DataFrame, after: DataFrame, record: str = "record_id") -> DataFrame:
    """Records that had annotations and have none any more; records without any before are not among them."""
    return before.select(record).distinct().join(after.select(record).distinct(), record, "left_anti")


def with_empty_policy(records: DataFrame, before: DataFrame, after: DataFrame, empty: str | None, record: str = "record_id") -> DataFrame:
    """``records`` without emptied ones (``drop``) or with them (``keep``); a policy must be named where there are annotations."""
    if empty not in ("drop", "keep"):
        if empty is not None or not before.isEmpty():
            raise ValueError("name what becomes of records left without annotations: drop or keep")
        return records
    return records.join(emptied(before, after, record), record, "left_anti") if empty == "drop" else records


# class lists


def check_names(known: list[str], names: list[str], flag: str) -> None:
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"{flag}: unknown classes {', '.join(missing)}; there are {', '.join(sorted(known)) or 'none'}")


@dataclass(frozen=True)
class Plan:
    """What each old class becomes (None: it goes), and the new class list."""

    to: dict[str, str | None]
    classes: list[str]


def keep_or_drop(classes: list[str], keep: list[str] | None = None, drop: list[str] | None = None) -> Plan:
    """Classes to keep, or to drop; not both. The others are numbered anew in their order."""
    if bool(keep) == bool(drop):
        raise ValueError("name classes to keep or classes to drop")
    check_names(classes, keep or drop or [], "keep" if keep else "drop")
    stay = [c for c in classes if (c in keep if keep else c not in drop)]
    return Plan({c: c if c in stay else None for c in classes}, stay)


def remap_plan(classes: list[str], merge: dict[str, list[str]] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None, others: str | None = None) -> Plan:
    """Merged, renamed and dropped classes; all that are not named stay, or become ``others``.

    The new list holds merged names, then new names, then what stays, then
    ``others``. A class named twice or unknown, a name made twice, and a name made
    that is another class's fail.
    """
    merge, rename, drop = merge or {}, rename or {}, drop or []
    moves = [(old, new) for new, olds in merge.items() for old in olds] + list(rename.items()) + [(old, None) for old in drop]
    named = [old for old, _ in moves]
    if len(set(named)) < len(named):
        raise ValueError(f"named more than once: {', '.join(sorted({x for x in named if named.count(x) > 1}))}")
    check_names(classes, named, "map")
    to, made = dict(moves), [*merge, *rename.values()]
    if len(set(made)) < len(made):
        raise ValueError(f"made twice: {', '.join(sorted({x for x in made if made.count(x) > 1}))}")
    taken = [x for x in made if x in classes and to.get(x) != x]
    if taken:
        raise ValueError(f"{', '.join(taken)}: also an existing class that is not among its sources")
    rest = [c for c in classes if c not in to]
    if others is not None:
        if others in made or (others in classes and others in to):
            raise ValueError(f"{others} is made or moved by the map")
        to |= dict.fromkeys(rest, others)
        made, rest = made + ([others] if rest else []), []
        made = [x for x in made if x != others] + ([others] if others in made else [])
    else:
        to |= {c: c for c in rest}
    return Plan(to, list(dict.fromkeys([*made, *rest])))


def _mapped(name: Column, plan: Plan) -> Column:
    """The new name of a class; null where it goes, unknown names stay."""
    gone = [c for c, new in plan.to.items() if new is None]
    table = F.create_map(*(F.lit(x) for old, new in plan.to.items() if new is not None for x in (old, new))) if any(v is not None for v in plan.to.values()) else None
    out = F.coalesce(F.try_element_at(table, name), name) if table is not None else name
    return F.when(name.isin(gone), F.lit(None).cast("string")).otherwise(out) if gone else out


def name_of(classes: list[str], cls: Column, label: Column) -> Column:
    """The class list's name, else the annotation's label, else an error."""
    named = F.try_element_at(F.array(*map(F.lit, classes)), F.when(cls >= 0, cls + 1)) if classes else F.lit(None).cast("string")
    fail = F.raise_error(F.concat(F.lit("class number without a name: "), cls.cast("string"))).cast("string")
    return F.coalesce(named, F.nullif(label, F.lit("")), fail)


def reindexed(anns: DataFrame, classes: list[str], plan: Plan) -> DataFrame:
    """Annotations with their new class number and label; those of classes that go are left out."""
    new = _mapped(name_of(classes, F.col("cls"), F.col("label")), plan)
    number = F.array_position(F.array(*map(F.lit, plan.classes)), F.col("label")) - 1 if plan.classes else F.lit(-1)
    d = anns.withColumn("label", new).where("label is not null")
    return d.withColumn("cls", number.cast("int"))


def reindexed_labels(df: DataFrame, plan: Plan, label: str = "label", probs: str = "probs", labels: str | None = None) -> DataFrame:
    """Classifications under new names; a record without any label left goes.

    ``probs`` is an array of (label, score) in order: scores of classes that
    become one are summed at the place of the first. ``labels`` are distinct, first
    come first. A label that goes, or that has no probability, becomes the most
    probable one (the first of equals), else the first of ``labels``.
    """
    d = df
    if labels:
        d = d.withColumn(labels, F.array_distinct(F.filter(F.transform(labels, lambda x: _mapped(x, plan)), lambda x: x.isNotNull())))
        d = d.where(F.col(labels).isNull() | (F.size(labels) > 0))
    moved = F.filter(F.transform(F.coalesce(probs, F.array().cast(df.schema[probs].dataType)), lambda p: F.struct(_mapped(p["label"], plan).alias("label"), p["score"].alias("score"))), lambda p: p["label"].isNotNull())
    d = d.withColumn("_p", moved)
    names = F.array_distinct(F.transform("_p", lambda p: p["label"]))
    summed = F.transform(names, lambda n: F.struct(n.alias("label"), F.aggregate(F.filter("_p", lambda p: p["label"] == n), F.lit(0.0), lambda a, p: a + p["score"]).alias("score")))
    d = d.withColumn(probs, summed)
    p = F.col(probs)
    best = F.when(F.size(p) > 0, F.aggregate(p, F.get(p, 0), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))["label"])
    new = _mapped(F.col(label), plan)
    known = F.exists(p, lambda x: x["label"] == new)
    first = F.get(F.col(labels), 0) if labels else F.lit(None).cast("string")
    chosen = F.when(new.isNotNull() & ((F.size(p) == 0) | known), new).otherwise(F.coalesce(best, first))
    return d.withColumn(label, chosen).drop("_p").where(F.col(label).isNotNull())


def inconsistent(anns: DataFrame, classes: list[str]) -> DataFrame:
    """Annotations whose class number is outside the list; a list with a name twice fails."""
    if len(set(classes)) < len(classes):
        raise ValueError("class names must be unique")
    return anns.where((F.col("cls") < 0) | (F.col("cls") >= len(classes)) | F.col("cls").isNull())


def reject_masks(records: DataFrame, mask: str, what: str) -> None:
    """Semantic masks cannot follow a change of classes."""
    if mask in records.columns and not records.where(F.col(mask).isNotNull()).isEmpty():
        raise ValueError(f"{what} does not take records with semantic masks")


def pruned(df: DataFrame, excluded: list[str], label: str = "label", probs: str = "probs", labels: str | None = None) -> DataFrame:
    """Classifications without some classes; a record that has nothing left goes.

    A label that goes gives way to the most probable of what is left; without
    probabilities to the first of ``labels``.
    """
    names = [x.strip() for x in excluded if x.strip()]
    if not names:
        return df
    out = lambda x: F.trim(x).isin(names)
    d = df
    if labels:
        d = d.withColumn(labels, F.filter(labels, lambda x: ~out(x))).where(F.col(labels).isNull() | (F.size(labels) > 0))
    had = F.coalesce(F.size(probs) > 0, F.lit(False))
    d = d.withColumn("_had", had).withColumn(probs, F.filter(probs, lambda p: ~out(p["label"])))
    d = d.where(~F.col("_had") | (F.size(probs) > 0))
    p = F.col(probs)
    best = F.when(F.coalesce(F.size(p), F.lit(0)) > 0, F.aggregate(p, F.get(p, 0), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))["label"])
    first = F.get(F.col(labels), 0) if labels else F.lit(None).cast("string")
    lost = F.coalesce(out(F.col(label)), F.lit(False))
    d = d.withColumn("_lost", lost & ~F.col("_had"))
    d = d.withColumn(label, F.when(F.col("_had") & (F.col(label).isNull() | lost), best).when(F.col("_lost"), first).otherwise(F.col(label)))
    return d.where(~F.col("_lost") | F.col(label).isNotNull()).drop("_had", "_lost")
