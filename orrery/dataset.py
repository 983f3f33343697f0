"""A dataset as tables, and the steps of a chain as methods.

``records`` has a row for each image (record_id in the order of the source, path,
split, width, height and whatever else is known of it), ``anns`` a row for each
annotation (record_id, ann, kind det, seg or pose, cls, label, cx, cy, w, h as
shares, points, score, group_id). Every step checks its arguments when it is
called, gives a new dataset, and is recorded with what it was given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import keys
from orrery.operators import annotations as A
from orrery.operators import gates, sampling, select, splitting

ANN = "record_id long, ann long, kind string, cls int, label string, cx double, cy double, w double, h double, points array<double>, score double, group_id long"


@dataclass(frozen=True)
class Dataset:
    records: DataFrame
    anns: DataFrame
    classes: tuple[str, ...] = ()
    task: str | None = None
    root: str | None = None
    format: str | None = None
    steps: tuple[dict, ...] = ()
    meta: dict = field(default_factory=dict)

    def with_(self, **changes: Any) -> Dataset:
        return replace(self, **changes)

    def step(self, name: str, args: dict, info: dict | None = None, **changes: Any) -> Dataset:
        """This dataset with changes, and the step recorded."""
        said = {"name": name, "args": {k: v for k, v in args.items() if v is not None}} | ({"info": info} if info else {})
        return replace(self, steps=(*self.steps, said), **changes)

    def pipe(self, *steps: Callable[[Dataset], Dataset]) -> Dataset:
        """The steps of a chain, one after another."""
        return reduce(lambda d, f: f(d), steps, self)

    # keys

    def key(self, spec: str, to: str = "key") -> DataFrame:
        """Records with the value of a key: ``split``, ``regex:``, ``dir:``, ``attr:`` or ``file:``; a record without one fails."""
        kind, _, arg = spec.partition(":")
        path = keys.layout_path(F.col("path"))
        if spec == "split":
            return self.records.withColumn(to, keys.split_key(F.col("split")))
        if kind == "file":
            from orrery.sources.files import key_table

            d = keys.file_key(self.records, key_table(self.records.sparkSession, arg), "path", to)
            return select.resolved(d, F.col(to), "path", spec, to)
        made: dict[str, Callable[[], Column]] = {"regex": lambda: keys.regex_key(path, arg), "dir": lambda: keys.dir_key(path, int(arg)), "attr": lambda: keys.attr_key(F.col("attributes"), arg)}
        if kind not in made or not arg:
            raise ValueError(f"unknown key {spec}")
        return select.resolved(self.records, made[kind](), "path", spec, to)

    def groups(self, specs: list[str], similar: int | None = None, h: str = "phash") -> DataFrame:
        """``(record_id, grp)``: the smallest layout path of all records that keys, equal paths or hashes at most ``similar`` bits apart connect."""
        from orrery.operators.graph import connected_components
        from orrery.operators.similarity import pairs_within

        base = self.records.select("record_id", keys.layout_path(F.col("path")).alias("layout"))
        edges = []

        def same(d: DataFrame, value: str) -> None:
            least = d.groupBy(value).agg(F.min("record_id").alias("b"))
            edges.append(d.join(least, value).select(F.col("record_id").alias("a"), "b"))

        same(base, "layout")
        for spec in specs:
            same(self.key(spec, "_key").select("record_id", "_key"), "_key")
        if similar is not None:
            edges.append(pairs_within(self.records, "record_id", h, similar).select("a", "b"))
        comp = connected_components(reduce(DataFrame.unionAll, edges).where("a <> b"))
        d = base.join(comp, F.col("record_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "record_id"))
        named = d.groupBy("c").agg(F.min("layout").alias("grp"))
        return d.join(named, "c").select("record_id", "grp")

    # steps

    def in_splits(self, wanted: list[str], prefix: bool = False) -> Dataset:
        r = select.in_splits(self.records, "split", wanted, prefix)
        return self.step("splits", {"splits": wanted}, records=r, anns=self._of(r))

    def _of(self, records: DataFrame, anns: DataFrame | None = None) -> DataFrame:
        return (self.anns if anns is None else anns).join(records.select("record_id"), "record_id", "left_semi")

    def sample(self, count: int | None = None, frac: float | None = None, stratify_by: list[str] | None = None, seed: int = 0) -> Dataset:
        """Records by hash of their keys, ``count`` or a share of each stratum; a stratum with fewer than ``count`` fails."""
        if (count is None) == (frac is None):
            raise ValueError("give a count or a share")
        if stratify_by and "class" in stratify_by:
            raise ValueError("strata are keys, not classes")
        d = keys.record_keys(self.records, "path", "path", "_key")
        by = []
        for i, spec in enumerate(stratify_by or []):
            d = d.join(self.key(spec, f"_s{i}").select("record_id", f"_s{i}"), "record_id")
            by.append(f"_s{i}")
        if count is not None:
            sampling.check_sizes(d, count, by)
            d = sampling.take(d, "_key", count, seed, by)
        else:
            d = sampling.take_share(d, "_key", frac, seed, by)
        r = d.drop("_key", *by)
        return self.step("sample", {"count": count, "frac": frac, "stratify_by": stratify_by, "seed": seed}, records=r, anns=self._of(r))

    def select(self, min_box_px: float | None = None, min_side_px: float | None = None, min_area_frac: float | None = None, keep_class: list[str] | None = None, drop_class: list[str] | None = None, exclude_name: list[str] | None = None, empty: str | None = None) -> Dataset:
        """Records by name, annotations by size and class; ``empty`` says what becomes of records that lose all of theirs."""
        sizes = {"min_box": min_box_px, "min_side": min_side_px, "min_area_frac": min_area_frac}
        sizing, classing = any(v is not None for v in sizes.values()), bool(keep_class or drop_class)
        if keep_class and drop_class:
            raise ValueError("keep classes or drop classes, not both")
        if not (sizing or classing or exclude_name):
            raise ValueError("select needs a rule")
        if any(v is not None and v <= 0 for v in sizes.values()):
            raise ValueError("sizes must be positive")
        if (sizing or classing) and empty not in ("drop", "keep"):
            raise ValueError("name what becomes of records left without annotations: drop or keep")
        r = select.without_names(self.records.withColumn("_layout", keys.layout_path(F.col("path"))), "_layout", exclude_name).drop("_layout") if exclude_name else self.records
        before = anns = self._of(r)
        classes = self.classes
        if sizing:
            d = anns.join(r.select("record_id", F.col("width").alias("_iw"), F.col("height").alias("_ih")), "record_id")
            rule = A.size_rule(F.col("w") * F.col("_iw"), F.col("h") * F.col("_ih"), (F.col("_iw") * F.col("_ih")).cast("double"), min_box_px, min_side_px, min_area_frac)
            anns = d.where(rule.isNull()).drop("_iw", "_ih")
        if classing:
            plan = select.keep_or_drop(list(classes), keep_class, drop_class)
            anns, classes = select.reindexed(anns, list(classes), plan), tuple(plan.classes)
        if sizing or classing:
            r = select.with_empty_policy(r, before, anns, empty)
        args = {"min_box_px": min_box_px, "min_side_px": min_side_px, "min_area_frac": min_area_frac, "keep_class": keep_class, "drop_class": drop_class, "exclude_name": exclude_name, "empty": empty}
        return self.step("select", args, records=r, anns=anns, classes=classes)

    def remap_classes(self, merge: dict | None = None, rename: dict | None = None, drop: list | None = None, others: str | None = None, empty: str | None = None) -> Dataset:
        select.reject_masks(self.records, "mask", "remap-classes")
        plan = select.remap_plan(list(self.classes), merge, rename, drop, others)
        anns = select.reindexed(self.anns, list(self.classes), plan)
        r = select.with_empty_policy(self.records, self.anns, anns, empty) if drop else self.records
        if "probs" in r.columns:
            r = select.reindexed_labels(r, plan)
        return self.step("remap-classes", {"merge": merge, "rename": rename, "drop": drop, "others": others, "empty": empty}, {"old_to_new": {k: v for k, v in plan.to.items() if k != v}}, records=r, anns=anns, classes=tuple(plan.classes))

    def split(self, val_frac: float = 0.0, test_frac: float = 0.0, folds: int | None = None, only_fold: list[int] | None = None, group_by: list[str] | None = None, similar: int | None = None, stratify_by: str = "class", keep: list[str] | None = None, on_siblings: str | None = None, tolerance: float = 0.05, seed: int = 0) -> Dataset:
        """Whole groups to splits, or to folds (their split in the first one present, all in ``fold_splits``)."""
        self._check_split(val_frac, test_frac, folds, only_fold, keep, on_siblings)
        spark = self.records.sparkSession
        groups = self.groups(group_by or [], similar)
        r = self.records.join(groups, "record_id")
        if on_siblings == "drop":
            r = splitting.drop_siblings(r.withColumn("_pin", F.when(F.col("split").isin(keep), F.col("split"))), "grp", "_pin").drop("_pin")
        weights = self.stratum_weights(stratify_by).join(r.select(F.col("record_id").alias("record")), "record", "left_semi")
        cells = splitting.group_counts(weights, r.select(F.col("record_id").alias("record"), "grp"))
        args = {"val_frac": val_frac, "test_frac": test_frac, "folds": folds, "group_by": group_by, "stratify_by": stratify_by, "keep": keep, "seed": seed}
        if folds is None:
            pins = r.where(F.col("split").isin(keep)).select("grp", "split").distinct() if keep else None
            placed = splitting.place(cells, {"train": 1 - val_frac - test_frac, "val": val_frac, "test": test_frac}, pins, seed)
            rows = splitting.report(placed)
            splitting.check(rows, tolerance)
            out = r.drop("split").join(placed.groups, "grp", "left").drop("grp")
            worst = splitting.max_deviation(rows)
            return self.step("split", args, {"mode": "ratio", "max_deviation": worst and round(abs(worst["achieved"] - worst["target"]), 4)}, records=out, anns=self._of(out))
        del spark
        out = splitting.fold_splits(r, "grp", None, folds, val_frac, seed) if stratify_by == "none" else splitting.fold_splits(r.join(self._main_class(), "record_id", "left"), "grp", "_class", folds, val_frac, seed).drop("_class")
        first = (only_fold or [0])[0]
        out = out.withColumn("split", F.element_at("fold_splits", first + 1)).drop("grp")
        return self.step("split", args, {"mode": "folds", "k": folds, "present": only_fold or list(range(folds))}, records=out, anns=self._of(out))

    @staticmethod
    def _check_split(val: float, test: float, folds: int | None, only: list[int] | None, keep: list[str] | None, siblings: str | None) -> None:
        if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
            raise ValueError("shares lie between 0 and 1 and sum to less than 1")
        if siblings and not keep:
            raise ValueError("siblings are those of kept records")
        if set(keep or ()) - set(splitting.SPLITS):
            raise ValueError(f"splits are {', '.join(splitting.SPLITS)}")
        if folds is None:
            if only:
                raise ValueError("there are no folds to choose from")
            if val <= 0 and test <= 0:
                raise ValueError("give a share or folds")
            if ("val" in (keep or ()) and val > 0) or ("test" in (keep or ()) and test > 0):
                raise ValueError("a kept split takes no share")
            return
        if folds < 2 or test > 0 or keep:
            raise ValueError("folds are two or more, have no test share and keep no splits")
        if only and (any(not 0 <= i < folds for i in only) or len(set(only)) < len(only)):
            raise ValueError(f"folds are numbered from 0 to {folds - 1}")

    def _main_class(self) -> DataFrame:
        n = self.labels().groupBy("record_id", "label").agg(F.count("*").alias("n"))
        return n.groupBy("record_id").agg(F.max_by("label", F.struct("n", "label")).alias("_class"))

    def labels(self) -> DataFrame:
        """``(record_id, label)``: annotations' labels, else the record's own."""
        own = splitting.record_labels(self.anns, "record_id", list(self.classes))
        if "label" not in self.records.columns:
            return own
        bare = self.records.where(F.col("label").isNotNull()).join(own.select("record_id").distinct(), "record_id", "left_anti")
        return own.unionAll(bare.select("record_id", "label"))

    def stratum_weights(self, by: str) -> DataFrame:
        """``(record, stratum, n)`` for ``none``, ``class``, ``class-size:EDGES`` or a key."""
        if by == "none":
            return splitting.none_weights(self.records, "record_id")
        if by == "class":
            return splitting.class_weights(self.records, self.labels(), "record_id", "label")
        if by.startswith("class-size:"):
            b = self.anns.where("kind <> 'seg' or points is not null").join(self.records.select("record_id", "width", "height"), "record_id")
            return splitting.class_size_weights(self.records, b, "record_id", "label", F.col("w") * F.col("width"), F.col("h") * F.col("height"), [float(x) for x in by.partition(":")[2].split(",")])
        return self.key(by, "_v").select(F.col("record_id").alias("record"), F.col("_v").alias("stratum"), F.lit(1).cast("long").alias("n"))

    def pixels(self) -> DataFrame:
        """Annotations with pixel edges and what filters need: image, label, kind, score, x1, y1, x2, y2."""
        d = self.anns.join(self.records.select("record_id", "width", "height"), "record_id")
        x, y, w, h = (F.col(a) * F.col(b) for a, b in (("cx", "width"), ("cy", "height"), ("w", "width"), ("h", "height")))
        return d.withColumns({"image": F.col("record_id"), "x1": x - w / 2, "y1": y - h / 2, "x2": x + w / 2, "y2": y + h / 2, "score": F.coalesce("score", F.lit(1.0))})

    def filter(self, config: gates.Config) -> Dataset:
        """Annotations that pass a filter's settings."""
        d = gates.box_features(self.pixels(), F.col("width"), F.col("height"))
        keep = gates.filtered(d, config).select("record_id", "ann")
        return self.step("filter", {"global": config.common, "per_class": config.by_class}, anns=self.anns.join(keep, ["record_id", "ann"], "left_semi"))

    def rebox(self, margin: float = 0.0) -> Dataset:
        """Pose boxes become the extent of their visible keypoints, grown by the margin on each side; other annotations of those records go."""
        from orrery.operators.geometry import box_of_keypoints

        pose = self.anns.where("kind = 'pose'").withColumn("_b", box_of_keypoints(F.col("points"), margin)).where("_b is not null")
        made = pose.withColumns({c: F.col("_b")[c] for c in ("cx", "cy", "w", "h")}).drop("_b")
        rest = self.anns.join(made.select("record_id").distinct(), "record_id", "left_anti")
        return self.step("rebox", {"margin": margin}, anns=rest.unionByName(made))

    def resized(self, width: int, height: int) -> Dataset:
        """Images of another size; shares stay."""
        if width <= 0 or height <= 0:
            raise ValueError("sizes must be positive")
        return self.step("resized", {"width": width, "height": height}, records=self.records.withColumns({"width": F.lit(width), "height": F.lit(height)}))

    def crops(self, margin_frac: float = 0.0, margin_px: float = 0.0, square: bool = False) -> DataFrame:
        """A row for each box that is no pose (polygons only where a record has no boxes): its crop's rectangle and id; crops outside the image are left out."""
        from orrery.operators import geometry

        d = self.pixels().where("kind <> 'pose'")
        has_box = F.max(F.col("kind") == "det").over(Window.partitionBy("record_id"))
        d = d.withColumn("_b", has_box).where("kind = 'det' or not _b").drop("_b")
        w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        if square:
            rect = geometry.square(F.col("x1"), F.col("y1"), w, h, F.col("width"), F.col("height"), margin_frac, margin_px)
        else:
            rect = geometry.crop(F.col("x1") - margin_px, F.col("y1") - margin_px, w + 2 * margin_px, h + 2 * margin_px, F.col("width"), F.col("height"), margin_frac)
        kind = F.when(F.col("kind") == "det", "box").otherwise("polygon")
        r = self.records.select("record_id", "path", keys.split_key(F.col("split")).alias("split"))
        d = d.withColumn("rect", rect).where("rect is not null").join(r, "record_id")
        return d.select("record_id", "ann", "label", geometry.crop_id(F.col("split"), F.col("path"), kind, F.col("ann")).alias("crop_id"), "rect.*")

    def negatives(self, imgsz: int = 512, per_image: int | None = 3, ratio: float | None = None, within: str = "image", splits: list[str] | None = None, seed: int = 0) -> DataFrame:
        from orrery.operators import negatives

        r = self.records if not splits else self.records.where(keys.split_key(F.col("split")).isin(splits))
        r = r.select("record_id", keys.layout_path(F.col("path")).alias("key"), "split", "width", "height")
        return negatives.plan(r, self.pixels().select("record_id", "x1", "y1", "x2", "y2"), imgsz, per_image if ratio is None else None, ratio, within, seed)

    def audit(self) -> DataFrame:
        """By split and in all: images with and without annotations, by kind, annotations, and resolutions."""
        n = self.anns.groupBy("record_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("det", "seg", "pose")))
        d = self.records.select("record_id", keys.split_key(F.col("split")).alias("split"), "width", "height").join(n, "record_id", "left").fillna(0, ["n", "det", "seg", "pose"])
        two = lambda c: F.round(F.avg(c), 2)
        return d.rollup("split").agg(
            F.count("*").alias("images"), F.count_if(F.col("n") > 0).alias("annotated"), F.count_if(F.col("n") == 0).alias("empty"),
            *(F.count_if(F.col(k) > 0).alias(f"images_{k}") for k in ("det", "seg", "pose")), *(F.sum(k).alias(k) for k in ("det", "seg", "pose")),
            F.min("width").alias("min_width"), F.max("width").alias("max_width"), two("width").alias("mean_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"), two("height").alias("mean_height"),
        )

    def fold(self, i: int) -> Dataset:
        r = splitting.of_fold(self.records, i)
        return self.with_(records=r, anns=self._of(r))

    def write(self, root: str, format: str, overwrite: bool = False, **options: Any) -> Any:
        from orrery.sources.router import write_dataset

        return write_dataset(self, root, format, overwrite, **options)

    def save(self, folder: str) -> None:
        """All tables and facts below a folder."""
        from orrery.sources.configs import write_document

        self.records.write.parquet(f"{folder}/records")
        self.anns.write.parquet(f"{folder}/anns")
        write_document(self.records.sparkSession, {"classes": list(self.classes), "task": self.task, "root": self.root, "format": self.format, "steps": list(self.steps), "meta": self.meta}, f"{folder}/dataset.json")

    @staticmethod
    def load(spark, folder: str) -> Dataset:
        from orrery.sources.configs import loaded

        d = loaded(spark, f"{folder}/dataset.json")
        return Dataset(spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/anns"), tuple(d["classes"]), d["task"], d["root"], d["format"], tuple(d["steps"]), d["meta"])


def union(datasets: list[Dataset]) -> Dataset:
    """All rows: classes united by name in the order first met, numbers anew, paths below their own root, the task where all agree."""
    classes = list(dict.fromkeys(c for d in datasets for c in d.classes))
    records, anns = [], []
    for i, d in enumerate(datasets):
        number = lambda c, i=i: (F.lit(i).cast("long") * (1 << 48) + c)
        path = F.when(F.col("path").rlike("^(/|[a-z0-9]+:)"), F.col("path")).otherwise(F.concat_ws("/", F.lit(d.root), "path")) if d.root else F.col("path")
        records.append(d.records.withColumn("record_id", number(F.col("record_id"))).withColumn("path", path).withColumn("src", F.lit(i)))
        a = select.reindexed(d.anns, list(d.classes), select.Plan({c: c for c in d.classes}, classes)) if d.classes else d.anns
        anns.append(a.withColumn("record_id", number(F.col("record_id"))))
    join = lambda x: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), x)
    tasks = {d.task for d in datasets}
    return Dataset(join(records), join(anns), tuple(classes), tasks.pop() if len(tasks) == 1 else None, None, None, (), {"sources": [d.root for d in datasets]})
