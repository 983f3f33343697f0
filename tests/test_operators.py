import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import keys
from orrery.operators import annotations as ann
from orrery.operators import answers, matching, profile, sampling, similarity, splitting
from orrery.operators.graph import connected_components


def test_components_match_a_plain_search(spark):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, 101), (101, 102), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in e:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_layout_path_keeps_the_last_part(spark):
    d = spark.createDataFrame([("train/images/a.jpg",), ("images",), ("pcb/train/a.jpg",), (None,)], "p string")
    assert [r[0] for r in d.select(keys.layout_path(F.col("p"))).collect()] == ["a.jpg", "images", "pcb/train/a.jpg", None]


def test_dir_and_regex_keys(spark):
    d = spark.createDataFrame([("a/b/c.jpg",), ("c.jpg",)], "p string")
    got = d.select(keys.dir_key(F.col("p"), 0), keys.dir_key(F.col("p"), -1), keys.regex_key(F.col("p"), r"(\w)\.jpg"), keys.regex_key(F.col("p"), "b")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "c", "b"), (None, None, "c", None)]


def test_file_key_rejects_repeated_names(spark):
    r = spark.createDataFrame([("x/a.jpg",), ("y/a.jpg",), ("y/b.jpg",)], "path string")
    k = spark.createDataFrame([("x/a.jpg", "1"), ("b.jpg", "2"), ("a.jpg", "3")], "name string, v string")
    assert {x.path: x.key for x in keys.file_key(r, k).collect()} == {"x/a.jpg": "1", "y/a.jpg": None, "y/b.jpg": "2"}
    with pytest.raises(Exception, match="repeated name"):
        keys.file_key(r, k.union(k)).collect()


def test_samples_nest_and_ignore_order(spark):
    d = spark.range(200).withColumn("c", F.col("id") % 3)
    small, large = ({r.id for r in sampling.take(d, "id", k, by=["c"]).collect()} for k in (3, 9))
    assert small < large and len(small) == 9
    assert {r.id for r in sampling.take(d.orderBy(F.desc("id")), "id", 3, by=["c"]).collect()} == small


def test_suppression_matches_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 5), int(i), float(x), float(y), float(x + w), float(y + h), float(s), "ab"[i % 2]) for i, (x, y, w, h, s) in enumerate(np.round(rng.random((80, 5)) * [50, 50, 40, 40, 9]) / [1, 1, 1, 1, 10])]
    d = spark.createDataFrame(rows, "image long, ann long, x1 double, y1 double, x2 double, y2 double, score double, label string")

    def iou(p, q):
        side = lambda i: max(0.0, min(p[i + 2], q[i + 2]) - max(p[i], q[i]) + 1)
        area = lambda b: (b[4] - b[2] + 1) * (b[5] - b[3] + 1)
        return side(2) * side(3) / (area(p) + area(q) - side(2) * side(3) + 1e-9)

    for across in (None, "label"):
        want = set()
        for image in range(5):
            kept = []
            for p in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):
                if all(iou(p, q) <= 0.3 for q in kept if across is None or q[7] != p[7]):
                    kept.append(p)
            want |= {p[1] for p in kept}
        assert {r.ann for r in ann.nms(d, ["image"], 0.3, across=across).collect()} == want


def test_matching_is_one_to_one_and_best_first(spark):
    s = "image long, ann long, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0), (2, 3, 0.0, 0.0, 5.0, 5.0)], s)
    t = spark.createDataFrame([(1, 9, 0.0, 0.0, 10.0, 10.0)], s)
    assert {r.ann: r.tp for r in matching.matched(p, t, ["image"]).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("limit", [0, 3, 20])
def test_hash_pairs_and_sequential_dedup_are_exact(spark, limit):
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, 60)
    h[30:] = h[:30] ^ np.array([sum(1 << int(b) for b in rng.choice(63, limit // 2, replace=False)) for _ in range(30)])
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "id long, h long")
    dist = lambda a, b: bin((int(h[a]) ^ int(h[b])) & (2**64 - 1)).count("1")
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if dist(a, b) <= limit}
    first = {int(x): i for i, x in reversed(list(enumerate(h)))}
    want = {(a, b) for a, b in want if first[int(h[a])] == a and first[int(h[b])] == b and h[a] != h[b]}
    assert {(r.a, r.b) for r in similarity.pairs_within(d, "id", "h", limit).collect()} == want
    assert {r.id: r.a for r in similarity.members(d, "id", "h").collect()} == {i: first[int(x)] for i, x in enumerate(h)}
    kept = []
    for i in range(60):
        if all(dist(i, j) > limit for j in kept):
            kept.append(i)
    assert sorted(r.id for r in similarity.sequential_dedup(d, "id", "h", limit).collect()) == kept


def test_splits_keep_groups_whole_and_shares_close(spark):
    d = spark.range(600).select("id", (F.col("id") % 60).alias("g"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("c"))
    out = splitting.split(d, "g", "c", {"train": 0.7, "val": 0.15, "test": 0.15})
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 420) <= 20 and abs(n["val"] - 90) <= 20
    again = splitting.split(d.orderBy(F.desc("id")), "g", "c", {"train": 0.7, "val": 0.15, "test": 0.15})
    assert again.join(out.withColumnRenamed("split", "s"), "id").where("split <> s").count() == 0


def test_pins_hold(spark):
    d = spark.range(100).select("id", (F.col("id") % 10).alias("g"), F.lit("x").alias("c"), F.when(F.col("id") == 3, "test").alias("pin"))
    out = splitting.split(d, "g", "c", {"train": 0.8, "test": 0.2}, pinned="pin")
    assert {r.split for r in out.where("g = 3").collect()} == {"test"}


def test_conflicting_pins_and_tolerance_fail(spark):
    d = spark.range(40).select("id", (F.col("id") % 4).alias("g"), F.lit("x").alias("c"), F.when(F.col("id") == 3, "test").when(F.col("id") == 7, "train").alias("pin"))
    with pytest.raises(ValueError, match="pinned to test and to train|pinned to train and to test"):
        splitting.split(d, "g", "c", {"train": 0.8, "test": 0.2}, pinned="pin")
    with pytest.raises(ValueError, match="instead of"):
        splitting.split(d.drop("pin"), "g", "c", {"train": 0.9, "test": 0.1}, tolerance=0.01)
    left = splitting.drop_siblings(d, "g", "pin")
    assert {r.id for r in left.where("g = 3").collect()} == {3, 7}


def test_pins_and_strata_hold_where_groups_are_dealt(spark, monkeypatch):
    g = F.floor(F.col("id") / 2)
    d = spark.range(2400).select("id", g.alias("g"), F.when((g % 3 == 0) & (F.col("id") % 2 == 0), "x").otherwise("y").alias("c"), F.when((g < 30) & (F.col("id") % 2 == 1), "test").alias("pin"))
    cells = splitting._cells(d, "g", "c")
    pins = d.where("pin is not null").select(F.col("g").alias("grp"), F.col("pin").alias("split"))
    placed = splitting.place(cells, {"train": 0.8, "test": 0.2}, pins, largest=50)
    out = d.join(placed.groups, F.col("g") == F.col("grp")).cache()
    assert out.count() == 2400 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    assert {r.split for r in out.where("g < 30").collect()} == {"test"}
    n = {(r.c, r.split): r["count"] for r in out.where("g >= 30").groupBy("c", "split").count().collect()}
    for c, all_of in (("x", 390), ("y", 1950)):
        assert abs(n[c, "train"] - 0.8 * all_of) <= 4


def test_folds_test_every_record_once(spark):
    d = spark.range(300).select("id", (F.col("id") % 30).alias("g"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    out = splitting.fold_splits(d, "g", "c", 3, 0.25)
    assert out.where(F.size(F.filter("fold_splits", lambda s: s == "test")) != 1).count() == 0
    assert 150 <= splitting.of_fold(out, 0).where("split <> 'test'").count() <= 230
    with pytest.raises(ValueError, match="groups"):
        splitting.folds(d.where("g < 2"), "g", "c", 5)


def test_average_precision_ranks_within_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "a" if i % 3 else "b", float(rng.integers(0, 40)), bool(rng.random() < 0.4)) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, label string, score double, tp boolean").repartition(6)
    out = ann.average_precision(d, "label", 100, ["id"])
    for r in out.collect():
        hits = np.array([x[3] for x in sorted((x for x in rows if x[1] == r.label), key=lambda x: (-x[2], x[0]))])
        rate = np.cumsum(hits) / np.arange(1, len(hits) + 1)
        best = np.maximum.accumulate(rate[::-1])[::-1]
        assert np.isclose(r.ap, best[hits].sum() / 100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(label" in plan and not re.search(r"windowspecdefinition\(label#\d+, score", plan)


@pytest.mark.parametrize(
    "text,label,rule",
    [("Yes!", "yes", "full_answer"), ("well\nno", "no", "edge_lines"), ("I think the answer is yes", "yes", "leadin_span"), ("no because of it", "no", "trimmed_span"), ("yes\nno", "unclear", "edge_lines:ambiguous"), ("", "unclear", "empty"), (None, "unclear", "empty"), ("perhaps", "unclear", "no_match"), ("(b).", "no", "full_answer"), ("I choose option A, or b?", "unclear", "no_match"), ("I picked (a)", "yes", "symbolic_token")],
)
def test_answers(spark, text, label, rule):
    called = answers.Registry.of(["yes", "no"], {"yes": ["a"], "no": ["b"]})
    r = answers.map_answers(spark.createDataFrame([(text,)], "a string"), "a", called).first()
    assert (r.label, r.rule) == (label, rule) or (text or "").startswith("I choose") and r.label in ("yes", "unclear")


def test_quantiles_and_bins(spark):
    d = spark.createDataFrame([("a", float(x)) for x in range(11)], "c string, v double")
    assert profile.size_quantiles(d, "c", F.col("v")).first().p50 == 5.0
    assert {r.v: r.bin for r in profile.quartile_bins(d, "v", F.lit(True)).collect()}[8.0] == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_query_runs_and_has_stable_columns(spark):
    from orrery.plans import catalog, more

    # those of the second catalogue that do not run jobs of their own to begin with
    light = ["key_attr", "safe_names", "numbers", "select_polygons", "empty_policy_drop", "remap_prob_sum", "threshold_filter", "crop_square", "polygon_clip", "flatten_names", "action_plan", "provider_answers", "health_table", "chain_audit"]
    for name, f in catalog.QUERIES.items():
        if f.__module__ == catalog.__name__ or name in light:
            assert f(spark, "/root/testdata/sf0.001").columns, name
    assert set(light) <= set(dir(more))
    assert catalog.FLAGSHIP(spark, "/root/testdata/sf0.001").count() > 0
