"""Keeping annotations by thresholds, with overrides for classes, or by a fitted logistic gate."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import dropped, written

EPS = 1e-12


def passes(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether each named column lies within its (least, most); a null value fails where there is a bound."""
    ok = F.lit(True)
    for name, (least, most) in limits.items():
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
    return F.coalesce(ok, F.lit(False))


def by_class(label: str, limits: dict, overrides: dict[str, dict]) -> Column:
    """``passes`` with the class's own limits where it has some; they replace the common ones as a whole."""
    ok = passes(limits)
    for name, own in overrides.items():
        ok = F.when(F.col(label) == name, passes(own)).otherwise(ok)
    return ok


@dataclass(frozen=True)
class Gate:
    """Weights of standardised features, and the least log-odds to stay."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    least: float = 0.0

    @staticmethod
    def log_odds(probability: float) -> float:
        return math.log(probability / (1 - probability + EPS) + EPS)

    def z(self) -> Column:
        """Log-odds of a row; null where a feature is missing."""
        total = F.lit(self.bias)
        for name, m, s, w in zip(self.features, self.mean, self.std, self.weights):
            total = total + w * (F.col(name) - m) / (s + EPS)
        return total


def gated(df: DataFrame, label: str, gates: dict[str, Gate], limits: dict, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Rows that their class's gate keeps; without a gate, or with a feature missing, those that pass the limits."""
    ok = by_class(label, limits, overrides or {})
    keep = ok
    for name, g in gates.items():
        keep = F.when(F.col(label) == name, F.coalesce(g.z() >= g.least, ok)).otherwise(keep)
    return df.where(keep)


@dataclass(frozen=True)
class Fit:
    """Weights of standardised features with the bias last, and the diagonal of their covariance."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    beta: tuple[float, ...]
    variance: tuple[float, ...]

    def gate(self, least: float = 0.0) -> Gate:
        return Gate(self.features, self.mean, self.std, self.beta[:-1], self.beta[-1], least)

    def p_values(self) -> dict[str, float]:
        """By feature, how likely so large a weight is by chance (Wald)."""
        return {f: math.erfc(abs(b) / math.sqrt(max(v, EPS)) / math.sqrt(2)) for f, b, v in zip(self.features, self.beta, self.variance)}


def fitted(df: DataFrame, features: list[str], target: str, l2: float = 1e-3, steps: int = 50) -> Fit:
    """Logistic weights by Newton steps on all rows whose features and target (0 or 1) are known.

    Each step is one aggregate of as many sums as there are pairs of features, so
    only these reach the driver.
    """
    import numpy as np

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("_y")).dropna()
    base = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not base.n:
        raise ValueError("no rows to learn from")
    k = len(features)
    mean, std = [base[f"m{i}"] for i in range(k)], [s if s >= EPS else 1.0 for s in (base[f"s{i}"] for i in range(k))]
    x = [(F.col(c) - m) / s for c, m, s in zip(features, mean, std)] + [F.lit(1.0)]
    ridge = np.diag([l2 + 1e-6] * k + [1e-6])
    pull = np.diag([l2] * k + [0.0])
    w = np.zeros(k + 1)
    for _ in range(steps):
        z = sum((a * float(b) for a, b in zip(x, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
        slope = [F.sum(x[i] * (F.col("_y") - p)).alias(f"g{i}") for i in range(k + 1)]
        curve = [F.sum(x[i] * x[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        r = rows.agg(*slope, *curve).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + ridge
        step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k + 1)]) - pull @ w)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), EPS))  # separable rows would run away
        w += step
        if np.linalg.norm(step) < 1e-6:
            break
    return Fit(tuple(features), tuple(mean), tuple(std), tuple(w.tolist()), tuple(np.diag(np.linalg.inv(h)).tolist()))


def pruned(df: DataFrame, features: list[str], target: str, alpha: float = 0.05, l2: float = 1e-3, most: int = 10, fewest: int = 1, always: tuple[str, ...] = ()) -> Fit:
    """A fit without features that chance explains: the one of the largest p value above ``alpha`` goes, and all are fitted anew, until none does."""
    names = list(features)
    fit = fitted(df, names, target, l2)
    for _ in range(most):
        p = {f: v for f, v in fit.p_values().items() if v > alpha and f not in always}
        if not p or len(names) <= fewest:
            break
        names.remove(max(p, key=p.get))
        fit = fitted(df, names, target, l2)
    return fit


def percentiles(df: DataFrame, column: str, at: list[float]) -> list[float]:
    """Exact percentiles of ``column`` (no nulls), between the rows beside each place; none of an empty table. Only these rows reach the driver."""
    from orrery.operators.arrange import with_rank

    d = with_rank(df.select(column), [column], "_rank")
    n = d.count()
    places = [p * (n - 1) for p in at] if n else []
    wanted = sorted({int(x) for p in places for x in (math.floor(p), math.ceil(p))})
    value = dict(d.where(F.col("_rank").isin(wanted)).select("_rank", column).collect()) if n else {}
    low, high = lambda p: value[math.floor(p)], lambda p: value[math.ceil(p)]
    return [float(low(p) if math.floor(p) == p else (math.ceil(p) - p) * low(p) + (p - math.floor(p)) * high(p)) for p in places]


def best_threshold(df: DataFrame, fit: Fit, target: str, beta: float = 2.0) -> tuple[str, float, float]:
    """(kind, value, F-beta): of 17 percentiles of the log-odds and 17 probabilities the first with the best F-beta; one job of sums."""
    import numpy as np

    d = df.select(fit.gate().z().alias("z"), (F.col(target).cast("int") == 1).alias("y")).where("z is not null")
    at = [float(p) for p in np.linspace(0.1, 0.9, 17)]
    logits = percentiles(d, "z", at) or [0.0]
    tried = [("logit", float(t), float(t)) for t in logits] + [("prob", p, math.log(p / max(1 - p, EPS))) for p in at]
    sums = d.agg(F.count_if("y").alias("n"), *(f.alias(f"{k}{i}") for i, (_, _, t) in enumerate(tried) for k, f in (("tp", F.count_if((F.col("z") >= t) & F.col("y"))), ("fp", F.count_if((F.col("z") >= t) & ~F.col("y")))))).first()
    best = ("logit", 0.0, 0.0)
    for i, (kind, value, _) in enumerate(tried):
        score = f_beta(sums[f"tp{i}"], sums[f"fp{i}"], sums["n"] - sums[f"tp{i}"], beta)
        if score > best[2]:
            best = (kind, value, score)
    return best


def f_beta(tp: float, fp: float, fn: float, beta: float) -> float:
    p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    return (1 + beta * beta) * p * r / max(beta * beta * p + r, EPS) if p or r else 0.0


def train(df: DataFrame, features: list[str], target: str, l2: float = 1e-3, steps: int = 50, probability: float = 0.5) -> Gate:
    """A gate that keeps rows of at least ``probability``."""
    return fitted(df, features, target, l2, steps).gate(Gate.log_odds(probability))


def box_features(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds box_area_frac, short_side_frac and aspect_ratio of pixel boxes; sides count one pixel at least."""
    w, h = (F.greatest(F.lit(1.0), F.col(f"{a}2") - F.col(f"{a}1")) for a in "xy")
    return df.withColumns({"box_area_frac": w * h / (width * height + EPS), "short_side_frac": F.least(w, h) / (F.least(width, height) + EPS), "aspect_ratio": F.greatest(w, h) / F.least(w, h)})


#: Which limit of a class bounds which feature, and whether from below.
LIMITS = {
    "post_conf": ("score", True), "min_box_area_frac": ("box_area_frac", True), "max_box_area_frac": ("box_area_frac", False), "min_short_side_frac": ("short_side_frac", True), "min_ar": ("aspect_ratio", True), "max_ar": ("aspect_ratio", False),
    "mask_min_per_box": ("mask_per_box", True), "mask_min_circ": ("mask_circularity", True), "mask_min_solidity": ("mask_solidity", True), "mask_max_holes_frac": ("mask_holes_frac", False), "mask_min_ar": ("mask_ar", True), "mask_max_ar": ("mask_ar", False),
    "white_min_frac": ("white_frac", True), "black_max_frac": ("black_frac", False), "yellow_min_frac": ("yellow_frac", True), "red_min_frac": ("red_frac", True), "green_min_frac": ("green_frac", True), "blue_min_frac": ("blue_frac", True),
}
GLOBAL = ("nms_iou", "topk_per_class", "cross_class_iou", "require_mask", "det_conf", "seg_conf", "use_rgb")
GATE = ("features", "mean", "std", "weights", "bias", "threshold_type", "threshold_value")


@dataclass(frozen=True)
class Config:
    """Settings of a filter, for all classes and by class; unknown names fail."""

    common: dict
    by_class: dict[str, dict]

    def __post_init__(self) -> None:
        known = {*LIMITS, "det_conf", "seg_conf", "require_mask", "logistic_gate"}
        odd = [k for k in self.common if k not in GLOBAL] + [k for c in self.by_class.values() for k in c if k not in known]
        if odd:
            raise ValueError(f"unknown settings: {', '.join(odd)}")

    @staticmethod
    def of(det_conf: float | None = None, seg_conf: float | None = None, nms_iou: float | None = None, cross_class_iou: float | None = None, class_det_conf: dict[str, float] | None = None, class_seg_conf: dict[str, float] | None = None) -> Config:
        common = {k: v for k, v in (("det_conf", det_conf), ("seg_conf", seg_conf), ("nms_iou", nms_iou), ("cross_class_iou", cross_class_iou)) if v is not None}
        by: dict[str, dict] = {}
        for name, given in (("det_conf", class_det_conf), ("seg_conf", class_seg_conf)):
            for label, v in (given or {}).items():
                by.setdefault(label, {})[name] = v
        return Config(common, by)


def confident(config: Config, label: str = "label", kind: str = "kind") -> Column:
    """Whether a detection is sure enough: boxes by det_conf, polygons (kind seg) by seg_conf; a class's own value replaces the common one."""

    def of(name: str) -> Column:
        common = config.common.get(name)
        ok = F.lit(True) if common is None else F.col("score") >= common
        for k, own in config.by_class.items():
            if own.get(name) is not None:
                ok = F.when(F.col(label) == k, F.col("score") >= own[name]).otherwise(ok)
        return ok

    return F.when(F.col(kind) == "seg", of("seg_conf")).otherwise(of("det_conf"))


def within(limits: dict, columns: list[str]) -> Column:
    """Whether a detection keeps a class's limits; a feature that the table lacks, or that is null, does not bound."""
    ok = F.lit(True)
    for name, value in limits.items():
        if name in LIMITS and value is not None and LIMITS[name][0] in columns:
            c = F.col(LIMITS[name][0])
            ok = ok & F.coalesce(c >= value if LIMITS[name][1] else c <= value, F.lit(True))
    return ok


def filtered(df: DataFrame, config: Config, image: str = "image", label: str = "label", kind: str = "kind") -> DataFrame:
    """Detections that pass: confidence, then each class's gate (or its limits, without one or with a feature missing), then suppression and the best of each class.

    Columns: image, ann, label, kind, score, x1, y1, x2, y2 and any features; a
    mask is there where ``has_mask`` is true.
    """
    from orrery.operators import annotations as A

    d = df.where(confident(config, label, kind))
    keep = F.lit(True)
    for name, own in config.by_class.items():
        ok = within(own, d.columns)
        g = own.get("logistic_gate")
        if g and all(f in d.columns for f in g["features"]):
            k = len(g["features"])
            least = Gate.log_odds(g["threshold_value"]) if g.get("threshold_type", "logit") == "prob" else g.get("threshold_value", 0.0)
            gate = Gate(tuple(g["features"]), tuple(g.get("mean") or [0.0] * k), tuple(g.get("std") or [1.0] * k), tuple(g["weights"]), g.get("bias", 0.0), least)
            ok = F.coalesce(gate.z() >= gate.least, ok)
        if (own.get("require_mask") or config.common.get("require_mask")) and "has_mask" in d.columns:
            ok = ok & F.col("has_mask")
        keep = F.when(F.col(label) == name, ok).otherwise(keep)
    if config.common.get("require_mask") and "has_mask" in d.columns:
        keep = keep & F.col("has_mask")
    cross = config.common.get("cross_class_iou")
    return A.postprocess(d.where(keep), image, label, config.common.get("nms_iou", 0.6), config.common.get("topk_per_class"), cross if cross else None)


def confidence_grid(pred: DataFrame, truth: DataFrame, by: list[str], least: float = 0.5, grid: list[float] | None = None, kind: str = "kind") -> DataFrame:
    """``(det_conf, seg_conf, tp, fp, fn)`` of greedy matches at every pair of thresholds; a kind without scores of its own range has none (null).

    Every candidate pair meets the thresholds it passes, so all are matched in one
    job, apart from each other.
    """
    import numpy as np

    from orrery.operators import matching as M

    grid = grid or [round(float(x), 2) for x in np.linspace(0, 1, 21)]
    span = {r[0]: r[1] - r[2] for r in pred.groupBy(F.when(F.col(kind) == "seg", "seg").otherwise("det")).agg(F.max("score"), F.min("score")).collect()}
    values = {k: grid if span.get(k, 0.0) > 1e-4 else [None] for k in ("det", "seg")}
    points = pred.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in values["det"] for b in values["seg"])], "g int, det_conf double, seg_conf double")
    passes = F.when(F.col(kind) == "seg", F.coalesce(F.col("score") >= F.col("seg_conf"), F.lit(True))).otherwise(F.coalesce(F.col("score") >= F.col("det_conf"), F.lit(True)))
    pairs = M.candidates(pred, truth, by, least).join(pred.select(*by, F.col("ann").alias("p"), "score", kind), [*by, "p"])
    at = pairs.join(F.broadcast(points), passes).drop("det_conf", "seg_conf")  # at most 441 thresholds, a row for each that a pair passes
    tp = M.first_free(at, ["g", *by], [F.desc("iou"), "p", "t"]).groupBy("g").agg(F.count("*").alias("tp"))
    kept = pred.join(F.broadcast(points), passes).groupBy("g").agg(F.count("*").alias("kept"))
    n = truth.count()
    d = points.join(tp, "g", "left").join(kept, "g", "left").fillna(0, ["tp", "kept"])
    return d.select("det_conf", "seg_conf", "tp", (F.col("kept") - F.col("tp")).alias("fp"), (F.lit(n) - F.col("tp")).alias("fn"))


def best_confidence(grid: DataFrame, beta: float = 1.0) -> tuple[float | None, float | None, float]:
    """(det_conf, seg_conf, F-beta): the best of a grid, of equals the higher thresholds."""
    rows = [(f_beta(r.tp, r.fp, r.fn, beta), -1.0 if r.det_conf is None else r.det_conf, -1.0 if r.seg_conf is None else r.seg_conf, r) for r in grid.collect()]  # at most 441 rows
    score, _, _, r = max(rows, key=lambda x: (round(x[0], 12), x[1], x[2]))
    return r.det_conf, r.seg_conf, score


def best_suppression(pred: DataFrame, truth: DataFrame, image: str, label: str, least: float = 0.5, grid: tuple[float, ...] = (0.30, 0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80), across: bool = False, k: int | None = None) -> tuple[float, float]:
    """(limit, F1): the first limit of suppression, within or across classes, with the best micro F1."""
    from orrery.operators import annotations as A
    from orrery.operators import matching as M

    best = (grid[0], -1.0)
    for limit in sorted(grid):
        d = A.postprocess(pred, image, label, None if across else limit, k, limit if across else None)
        r = M.counts(M.matched(d, truth, [image, label], least), truth).first()
        score = f_beta(r.tp, r.fp, r.fn, 1.0)
        if score > best[1]:
            best = (limit, score)
    return best


#: Names of splits that hold training and validation images.
TRAIN_NAMES, VAL_NAMES = ("train", "training"), ("val", "valid", "validation", "test")


def training_split(images: DataFrame, key: str, split: str, share: float, seed: int = 0) -> DataFrame:
    """``images`` with ``fold`` train or val: by their split names where both kinds are there, else the given share by hash (half to even, never all)."""
    s = F.lower(F.trim(F.coalesce(F.nullif(F.col(split), F.lit("")), F.lit("train"))))
    n = images.agg(F.count("*"), F.count_if(s.isin(*VAL_NAMES)), F.count_if(s.isin(*TRAIN_NAMES))).first()
    if share <= 0 or n[0] < 2:
        return images.withColumn("fold", F.lit("train"))
    if n[1] and n[2]:
        return images.withColumn("fold", F.when(s.isin(*VAL_NAMES), "val").otherwise("train"))
    from orrery.operators import sampling

    val = sampling.take(images.select(key), key, min(round(n[0] * share), n[0] - 1), seed).withColumn("fold", F.lit("val"))
    return images.join(val, key, "left").withColumn("fold", F.coalesce("fold", F.lit("train")))


def train_config(pred: DataFrame, truth: DataFrame, features: list[str], image: str = "image", label: str = "label", least: float = 0.5, beta: float = 2.0, l2: float = 1e-3, alpha: float = 0.05, fewest: int = 1, always: tuple[str, ...] = (), tune: bool = True) -> Config:
    """A filter learned from matches: confidence, then a gate for each class with both hits and misses, then limits of suppression."""
    from orrery.operators import matching as M

    by = [image, label]
    common: dict = {}
    kept = pred
    if tune:
        det, seg, _ = best_confidence(confidence_grid(pred, truth, by, least), beta)
        common |= {k: v for k, v in (("det_conf", det), ("seg_conf", seg)) if v is not None}
        kept = pred.where(confident(Config(common, {}), label))
    marked = M.matched(kept, truth, by, least).select(label, "tp", F.col("tp").cast("int").alias("y"), *features)
    marked = written(marked, "marked")  # every step of every fit reads it
    classes = marked.groupBy(label).agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp")).collect()  # a row for each class
    own: dict[str, dict] = {}
    for c in sorted(classes):
        if c.tp and c.fp:
            rows = marked.where(F.col(label) == c[0])
            fit = pruned(rows, features, "y", alpha, l2, fewest=fewest, always=always)
            kind, value, _ = best_threshold(rows, fit, "y", beta)
            own[c[0]] = {"logistic_gate": {"features": list(fit.features), "mean": list(fit.mean), "std": list(fit.std), "weights": list(fit.beta[:-1]), "bias": fit.beta[-1], "threshold_type": kind, "threshold_value": value}}
    dropped(marked)
    if tune:
        common["nms_iou"] = best_suppression(kept, truth, image, label, least)[0]
    return Config(common, own)
