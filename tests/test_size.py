"""What keeps queries in bounds on large tables."""

import json
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orrery.dataset import Dataset
from orrery.operators import annotations as ann
from orrery.operators import gates, matching, similarity
from orrery.sources import folders, labelme, router


def test_precision_envelope_walks_no_frame_to_the_end(spark):
    d = spark.range(100).select("id", F.lit("a").alias("label"), (F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("tp"))
    plan = ann.average_precision(d, "label", 100, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    rows = [x.split("$())")[0] for x in plan.split("windowspecdefinition(")[1:] if x.startswith("label#")]
    assert rows and not any("unboundedfollowing" in x for x in rows)


def _hashes(spark, n=700):
    rng = np.random.default_rng(5)
    h = [int(x) for x in rng.integers(-(2**63), 2**63, n)]
    h[40:60] = h[:20]
    h[60:90] = [x ^ 0b1011 for x in h[:30]]
    rows = [(i * 3 % n, x) for i, x in enumerate(h)]
    return sorted(rows), spark.createDataFrame([*rows, (n, None)], "id long, h long").repartition(5)


def _apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_wide_pairs_links_and_rounds_by_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 100)
    monkeypatch.setattr(similarity, "ROUND", 130)
    rows, d = _hashes(spark)
    first, n = {}, Counter(h for _, h in rows)
    for i, h in rows:
        first.setdefault(h, i)
    want = {(a, b, _apart(x, y), n[x], n[y]) for x, a in first.items() for y, b in first.items() if a < b and _apart(x, y) <= 20}
    pairs = similarity.pairs_within(d, "id", "h", 20)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want

    root = {i: i for i in first.values()}
    for a, b, *_ in sorted(want):
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    component = {i: root[first[h]] for i, h in rows} | {700: 700}
    assert {r.id: r.component for r in similarity.similarity_components(d, "id", "h", 20).collect()} == component

    kept = []
    for i, h in rows:
        if all(_apart(h, k) > 20 for _, k in kept):
            kept.append((i, h))
    assert sorted(r.id for r in similarity.sequential_dedup(d, "id", "h", 20).collect()) == [i for i, _ in kept] + [700]


def test_nearest_by_several_blocks_and_without_hashes(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 100)
    rows, d = _hashes(spark)
    q, r = d.where("id % 5 = 0"), d.where("id % 5 <> 0")
    near = similarity.nearest(q, r, "id", "h", 3)
    got = {(x.q, x["rank"]): (x.r, x.dist) for x in near.collect()}
    for i, h in rows:
        if i % 5 == 0:
            best = sorted((_apart(h, y), j) for j, y in rows if j % 5)[:3]
            assert [got[i, k + 1] for k in range(3)] == [(j, x) for x, j in best]
    assert [got[700, k + 1] for k in range(3)] == [(1, None), (2, None), (3, None)]
    few = spark.createDataFrame([(1, 5), (2, None)], "id long, h long")
    assert [(x.r, x.dist) for x in similarity.nearest(q.where("id = 0"), few, "id", "h", 3).orderBy("rank").select("r", "dist").collect()][1] == (2, None)


def test_training_reads_written_matches_and_ranks_for_percentiles(spark):
    d = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 4, 4, 2, 8)], "z double").repartition(3)
    assert np.allclose(gates.percentiles(d, "z", [0.0, 0.25, 0.6, 1.0]), np.percentile([5, 1, 9, 4, 4, 2, 8], [0, 25, 60, 100]))
    assert gates.percentiles(d.where("false"), "z", [0.5]) == []


def test_polygons_go_to_boxes_as_one_record_at_a_time_would(spark):
    rng = np.random.default_rng(2)
    rows = []
    for r in range(40):
        for a in range(int(rng.integers(0, 30))):
            x, y = rng.integers(0, 40, 2).tolist()
            w, h = rng.integers(10, 40, 2).tolist()
            rows.append((r, a, ["det", "seg"][int(rng.integers(0, 2))], [None, "a", "b"][int(rng.integers(0, 3))], None if a % 2 else 0.5, int(rng.integers(0, 8)) if a % 3 == 0 else None, float(x), float(y), float(x + w), float(y + h)))
    d = spark.createDataFrame(rows, "record_id long, ann long, kind string, label string, score double, group_id long, x1 double, y1 double, x2 double, y2 double").repartition(4)
    want = set()
    for r in {x[0] for x in rows}:
        b = [x for x in rows if x[0] == r and x[2] == "det"]
        p = [x for x in rows if x[0] == r and x[2] == "seg"]
        free = set(range(len(p)))
        for x in b:
            own = [j for j, y in enumerate(p) if x[5] is not None and y[5] == x[5]]
            best = None
            if own:
                best = own[0]
            else:
                fit = [(-_iou(x[6:], p[j][6:]), j) for j in sorted(free) if x[3] is not None and p[j][3] == x[3] and _iou(x[6:], p[j][6:]) >= 0.3]
                best = min(fit)[1] if fit else None
            free.discard(best)
            want.add((r, x[1], None if best is None else p[best][1], x[3], x[4] or 1.0, *x[6:]))
        want |= {(r, None, p[j][1], p[j][3], p[j][4] or 1.0, *p[j][6:]) for j in free}
    out = matching.with_polygons(d.where("kind = 'det'"), d.where("kind = 'seg'"), least=0.3)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no call for each record


def _iou(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    size = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return w * h / (size(a) + size(b) - w * h)


def test_large_splits_are_several_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "DOCUMENT", 40)
    r = spark.range(60).select(F.col("id").alias("record_id"), F.format_string("i%03d.jpg", "id").alias("path"), F.when(F.col("id") < 50, "train").otherwise("val").alias("split"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    a = spark.range(120).select((F.col("id") % 55).alias("record_id"), F.col("id").alias("ann"), F.lit("det").alias("kind"), F.lit(0).alias("cls"), F.lit("x").alias("label"), *(F.lit(0.5).alias(c) for c in ("cx", "cy", "w", "h")), F.lit(None).cast("array<double>").alias("points"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("group_id"))
    root = f"file://{tmp_path}/out"
    folders.write_coco(Dataset(r, a, ("x",)), root)
    found = [f for f in (tmp_path / "out/train").iterdir() if f.suffix == ".json"]
    assert len(found) > 1 and all(len(json.loads(f.read_text())["images"]) < 50 for f in found)
    assert [f.name for f in (tmp_path / "out/val").iterdir() if f.suffix == ".json"] == ["_annotations.coco.json"]
    back = router.read_dataset(spark, root)
    assert back.format == "coco" and back.anns.count() == 120
    assert sorted((x.path, x.split) for x in back.records.collect()) == sorted((x.path, x.split) for x in r.collect())
    per = {x.path: x["count"] for x in back.anns.join(back.records, "record_id").groupBy("path").count().collect()}
    assert per == {x.path: x["count"] for x in a.join(r, "record_id").groupBy("path").count().collect()}


def test_tasks_list_and_read_shape_documents(spark, tmp_path):
    doc = lambda name, *labels: {"imagePath": name, "imageWidth": 10, "imageHeight": 20, "shapes": [{"label": x, "shape_type": "rectangle", "points": [[0, 0], [5, 10]]} for x in labels]}
    put = lambda name, data: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_bytes(data))
    put("train/deep er/a.json", json.dumps(doc("a.jpg", "x", "y")).encode("utf-8-sig"))
    put("val/b.json", json.dumps(doc("ü.jpg", "z"), ensure_ascii=False).encode("utf-16"))
    put("val/two.json", json.dumps([doc("c.jpg"), doc("d.jpg", "x")]).encode())
    put("empty.json", b" \n")
    put("wrong.json", b"{")
    for passed in ("val/_x.json", ".hidden/x.json", "_new/x.json", "val/x.JSON", "val/x.json.1.part"):
        put(passed, json.dumps(doc("no.jpg", "x")).encode())
    root = f"file://{tmp_path}"
    docs = labelme.documents(spark, root)
    got = sorted((r.file, r.imagePath or "", [x.label for x in r.shapes or []]) for r in docs.collect())
    assert got == [("train/deep er/a.json", "a.jpg", ["x", "y"]), ("val/b.json", "ü.jpg", ["z"]), ("val/two.json", "c.jpg", []), ("val/two.json", "d.jpg", ["x"]), ("wrong.json", "", [])]
    assert not [f for f in labelme.read(spark, root).inputFiles() if f.endswith(".json")]  # the driver has no list of them
    by_spark = labelme.documents(spark, f"file://{tmp_path}/[tvw]*")  # a pattern: listed by Spark's readers
    assert sorted((r.imagePath or "", len(r.shapes or [])) for r in by_spark.collect()) == sorted((p, len(x)) for _, p, x in got)
    back = folders.read_labelme(spark, root)
    assert {r.path for r in back.records.collect()} >= {"train/deep er/a.jpg", "val/ü.jpg"} and back.anns.where("label = 'y'").count() == 1
    assert router.Listing(spark, root).paths[0] == ".hidden/x.json" and len(router.Listing(spark, root).paths) == 10
