import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.dataset import Dataset, union
from orrery.functions import names, numeric
from orrery.operators import answers, arrange, gates, generation, geometry, matching, pixels, providers, questions, select, splitting, trust
from orrery.sources import configs, folders, router, sinks


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def yolo_tree(root):
    put(root / "data.yaml", "names: [cat, dog]")
    put(root / "train/images/a.jpg")
    put(root / "train/labels/a.txt", "0 0.5 0.5 0.2 0.4\n1 0.25 0.25 0.1 0.1")
    put(root / "val/images/b.jpg")
    put(root / "val/labels/b.txt", "")


def sized(d, w=100, h=50):
    return d.with_(records=d.records.withColumns({"width": F.lit(w), "height": F.lit(h)}))


def test_label_folders_are_found_read_and_written(spark, tmp_path):
    yolo_tree(tmp_path / "in")
    root = f"file://{tmp_path}/in"
    assert router.detect(spark, root) == "yolo" and router.detect_labels(spark, root) == "yolo"
    d = router.read_dataset(spark, root)
    assert {(r.path, r.split) for r in d.records.collect()} == {("train/images/a.jpg", "train"), ("val/images/b.jpg", "val")}
    assert d.classes == ("cat", "dog") and {(r.label, r.cls) for r in d.anns.collect()} == {("cat", 0), ("dog", 1)}
    assert {r.split for r in router.read_dataset(spark, root, splits=["val"]).records.collect()} == {"val"}
    for fmt in ("yolo", "coco", "labelme"):
        to = f"file://{tmp_path}/{fmt}"
        sized(d).write(to, fmt)
        with pytest.raises(FileExistsError):
            sized(d).write(to, fmt)
        if fmt == "yolo":
            assert (tmp_path / "yolo/labels/train/a.txt").read_text().startswith("0 0.500000 0.500000 0.200000 0.400000")
            continue
        assert router.detect(spark, to) == fmt
        back = router.read_dataset(spark, to)
        assert {(r.label, round(r.cx, 6), round(r.w, 6)) for r in back.anns.collect()} == {("cat", 0.5, 0.2), ("dog", 0.25, 0.1)}
        assert {r.split for r in back.records.collect()} == {"train", "val"}
    many = router.read_many(spark, [root, f"file://{tmp_path}/coco"])
    assert many.classes == ("cat", "dog") and many.records.count() == 4 and many.anns.count() == 4
    with pytest.raises(KeyError, match="no reader"):
        router.read_dataset(spark, root, "nope")


def test_detection_needs_one_answer(spark, tmp_path):
    assert router.chosen([(10, "b"), (50, "a")], "x") == "b"
    with pytest.raises(ValueError, match="a or b"):
        router.chosen([(10, "b"), (10, "a")], "x")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no format"):
        router.detect(spark, f"file://{tmp_path}/none")


def test_class_folders_masks_and_bare_images(spark, tmp_path):
    for p, t in (("c/train/cat/1.jpg", "x"), ("c/val/images/2.jpg", "y"), ("m/cat/1.jpg", "x"), ("m/dog/1.jpg", "x"), ("m/dog/2.jpg", "z"), ("f/a.png", "x"), ("f/b/c/d.png", "x")):
        put(tmp_path / p, t)
    at = lambda p: f"file://{tmp_path}/{p}"
    c = router.read_dataset(spark, at("c"))
    assert {(r.path, r.split, r.label) for r in c.records.collect()} == {("train/cat/1.jpg", "train", "cat"), ("val/images/2.jpg", "val", None)}
    m = folders.read_classes(spark, at("m"), multi=True)
    assert {r.path: r.labels for r in m.records.collect()} == {"cat/1.jpg": ["cat", "dog"], "dog/2.jpg": ["dog"]} and m.classes == ("cat", "dog")
    put(tmp_path / "m/cat/2.jpg", "other")
    with pytest.raises(ValueError, match="differ"):
        folders.read_classes(spark, at("m"), multi=True)
    with pytest.raises(ValueError, match="split folders"):
        folders.read_classes(spark, at("c"), multi=True)
    f = folders.read_flat(spark, at("f"), max_depth=0)
    assert [(r.path, r.sample_key) for r in f.records.collect()] == [("a.png", "a")]
    put(tmp_path / "s/data.yaml", "names: [sky]\ntrain: {images: im, masks: ma}\n")
    for p in ("s/im/x/1.jpg", "s/im/2.jpg", "s/im/3.jpg", "s/ma/x/1.pgm", "s/ma/x/1.png", "s/ma/2.tif"):
        put(tmp_path / p)
    s = router.read_dataset(spark, at("s"))
    assert {r.path: r.mask for r in s.records.collect()} == {"im/x/1.jpg": "ma/x/1.png", "im/2.jpg": "ma/2.tif", "im/3.jpg": None}
    with pytest.raises(ValueError, match="masks"):
        s.remap_classes(rename={"sky": "air"})
    places = folders.class_places(c).collect()
    assert {r.dst for r in places} == {"train/cat/1.jpg", "val/unlabeled/2.jpg"}
    folders.write_classes(c, at("out"), mode="hard")
    assert (tmp_path / "out/train/cat/1.jpg").stat().st_ino == (tmp_path / "c/train/cat/1.jpg").stat().st_ino
    with pytest.raises(ValueError, match="source"):
        sinks.claim(spark, at("c"), True, (at("c/train"),))


def test_shapes_with_points_are_poses(spark, tmp_path):
    shape = lambda label, kind, points: {"label": label, "shape_type": kind, "points": points}
    put(tmp_path / "a.json", json.dumps({"imagePath": "..\\x\\a.jpg", "imageWidth": 10, "imageHeight": 20, "shapes": [shape("p", "rectangle", [[0, 0], [5, 10]]), shape("eye", "point", [[1, 2]]), shape("eye", "point", [[4, 8]]), shape("q", "rectangle", [[6, 6], [9, 9]])]}))
    d = folders.read_labelme(spark, f"file://{tmp_path}")
    rows = {r.label: r for r in d.anns.collect()}
    assert rows["p"].kind == "pose" and rows["q"].kind == "det" and [round(x, 3) for x in rows["p"].points] == [0.1, 0.1, 2, 0.4, 0.4, 2]
    assert d.records.first().path == "a.jpg" and d.classes == ("p", "eye", "q")
    boxed = d.rebox(0.5).anns.first()
    assert [round(x, 6) for x in (boxed.cx, boxed.cy, boxed.w, boxed.h)] == [0.25, 0.25, 0.6, 0.6]


def test_questions_in_files(spark, tmp_path):
    put(tmp_path / "v/images/a.jpg")
    put(tmp_path / "v/other/a.jpg")
    put(tmp_path / "v/labels/a.json", json.dumps({"split": "train2014", "qa_pairs": [{"question_id": 7, "prompt": "what?", "answer": "cat", "meta": {"source": "me", "n": "1"}}]}))
    d = router.read_dataset(spark, f"file://{tmp_path}/v", "flat_vlm_json")
    r = d.records.first()
    assert (r.image, r.split, r.qas[0].question, r.qas[0].id, r.qas[0].source, r.qas[0].meta) == ("images/a.jpg", "train2014", "what?", "7", "me", {"n": "1"})
    assert d.in_splits(["train"], prefix=True).records.count() == 1
    with pytest.raises(ValueError, match="train2014"):
        d.in_splits(["val"])
    d.write(f"file://{tmp_path}/w", "flat_vlm_json")
    (name,) = (tmp_path / "w").glob("*.json")
    doc = json.loads(name.read_text())
    assert doc["qa_pairs"][0] == {"question": "what?", "question_id": "7", "answer": "cat", "meta": {"n": "1", "source": "me"}}
    q = {"questions": [{"question_id": 1, "image_id": 12, "question": "first"}, {"question_id": 1, "image_id": 12, "question": "second"}, {"question_id": 2, "image_id": 12, "question": "other"}]}
    put(tmp_path / "r/q_train2014.json", json.dumps(q))
    put(tmp_path / "r/a.json", json.dumps({"annotations": [{"question_id": 1, "image_id": 12, "multiple_choice_answer": "yes", "answers": [{"answer": "yes"}, {"answer": "no"}]}]}))
    put(tmp_path / "r/p.json", json.dumps([{"question_id": 2, "answer": "said"}]))
    put(tmp_path / "r/img_000012.jpg")
    v = router.read_dataset(spark, f"file://{tmp_path}/r", "vqa_style").records.first()
    assert v.path == "img_000012.jpg" and v.split == "train2014"
    assert [(x.question, x.answer, x.ground_truth, x.expected) for x in v.qas] == [("first", "", "yes", ["yes", "no"]), ("other", "said", None, None)]
    t = spark.createDataFrame([('[{"question":"q","answer":"a"}]',), ("w\tx\ny|z\nalone",)], "t string")
    assert [[tuple(x) for x in r[0]] for r in t.select(folders.parsed_answer(F.col("t"))).collect()] == [[("q", "a")], [("w", "x"), ("y", "z"), ("", "alone")]]


def boxes(spark, n=40):
    r = spark.range(n).select(F.col("id").alias("record_id"), F.format_string("g%d/i%02d.jpg", F.col("id") % 8, "id").alias("path"), F.lit(None).cast("string").alias("split"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    label = F.when(F.col("record_id") % 2 == 0, "a").otherwise("b")
    a = r.select("record_id", F.lit(1).cast("long").alias("ann"), F.lit("det").alias("kind"), F.when(label == "a", 0).otherwise(1).alias("cls"), label.alias("label"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), (0.05 + F.col("record_id") % 5 * 0.1).alias("w"), F.lit(0.2).alias("h"), F.lit(None).cast("array<double>").alias("points"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("group_id"))
    return Dataset(r, a, ("a", "b"), "det", "/data")


def test_steps_check_their_arguments_and_are_recorded(spark, tmp_path):
    d = boxes(spark)
    for bad in (dict(), dict(min_box_px=5), dict(keep_class=["a"], drop_class=["b"], empty="drop"), dict(min_box_px=-1, empty="drop"), dict(keep_class=["z"], empty="drop")):
        with pytest.raises(ValueError):
            d.select(**bad)
    small = d.select(min_box_px=12, empty="drop")
    assert small.records.count() == 32 and small.anns.count() == 32 and d.records.count() == 40
    assert d.select(min_box_px=12, empty="keep").records.count() == 40
    one = d.select(drop_class=["a"], exclude_name=["^g1/"], empty="drop")
    assert one.classes == ("b",) and {r.cls for r in one.anns.collect()} == {0} and one.records.count() == 15
    s = d.pipe(lambda x: x.remap_classes(merge={"c": ["a", "b"]}), lambda x: x.split(test_frac=0.25, group_by=["dir:0"]))
    assert [x["name"] for x in s.steps] == ["remap-classes", "split"] and s.classes == ("c",)
    assert {r["count"] for r in s.records.groupBy("split").count().collect()} == {30, 10}
    for bad in (dict(), dict(val_frac=0.6, test_frac=0.5), dict(folds=1), dict(folds=3, test_frac=0.1), dict(folds=3, only_fold=[4]), dict(val_frac=0.1, keep=["val"]), dict(val_frac=0.1, on_siblings="drop")):
        with pytest.raises(ValueError):
            d.split(**bad)
    f = d.split(folds=4, group_by=["dir:0"], val_frac=0.2)
    assert {r.split for r in f.fold(2).records.collect()} <= {"train", "val", "test"}
    assert f.sample(count=5).records.count() == 5 and f.sample(frac=0.5, stratify_by=["dir:0"]).records.count() == 16
    with pytest.raises(ValueError, match="wanted"):
        d.sample(count=99)
    with pytest.raises(ValueError, match="resolve"):
        d.key("dir:3").count()
    with pytest.raises(ValueError, match="unknown key"):
        d.key("what:x")
    s.save(f"file://{tmp_path}/saved")
    back = Dataset.load(spark, f"file://{tmp_path}/saved")
    assert back.classes == s.classes and back.steps[0]["name"] == "remap-classes" and back.anns.count() == 40
    assert d.resized(10, 20).crops(square=True).first().right - d.resized(10, 20).crops(square=True).first().left > 0
    assert d.crops().select("crop_id").first()[0].startswith("train:g0/i00.jpg:box:1")
    assert d.negatives(10, per_image=1).count() == 40
    u = union([d, d.with_(classes=("b", "a"), anns=d.anns.withColumn("cls", 1 - F.col("cls")))])
    assert u.classes == ("a", "b") and u.anns.where("label = 'a' and cls <> 0").count() == 0 and u.records.first().path.startswith("/data/")


def test_class_plans(spark):
    plan = select.remap_plan(["a", "b", "c"], {"x": ["a"]}, {"b": "y"}, None, "z")
    assert plan.to == {"a": "x", "b": "y", "c": "z"} and plan.classes == ["x", "y", "z"]
    assert select.remap_plan(["a", "b"], {"a": ["a", "b"]}).classes == ["a"]
    for bad in (({"x": ["a"]}, {"a": "y"}), ({"x": ["q"]}, None), ({"x": ["a"]}, {"b": "x"}), ({"c": ["a"]}, None)):
        with pytest.raises(ValueError):
            select.remap_plan(["a", "b", "c"], *bad)
    with pytest.raises(ValueError):
        select.remap_plan(["a", "b"], {"x": ["a"]}, None, None, "x")
    p = spark.createDataFrame([(1, "a", [("a", 0.5), ("b", 0.3), ("c", 0.2)], ["a", "b"]), (2, "c", [], ["c"]), (3, None, [("c", 1.0)], None)], "i int, label string, probs array<struct<label:string,score:double>>, labels array<string>")
    out = {r.i: r for r in select.reindexed_labels(p, select.remap_plan(["a", "b", "c"], {"x": ["a", "b"]}, None, ["c"]), labels="labels").collect()}
    assert set(out) == {1} and out[1].label == "x" and [tuple(x) for x in out[1].probs] == [("x", 0.8)] and out[1].labels == ["x"]
    assert {r.i: r.label for r in select.pruned(p, ["a"], labels="labels").collect()} == {1: "b", 2: "c", 3: "c"}


def test_names_and_numbers(spark):
    d = spark.createDataFrame([(1, "k"), (2, "k_1"), (3, "k"), (4, "k"), (5, "z")], "i int, k string")
    assert {r.i: r.unique_key for r in names.unique_keys(d, "k", "i").collect()} == {1: "k", 2: "k_1", 3: "k_2", 4: "k_3", 5: "z"}
    assert sorted(["m10b", "m2b", "m2a"], key=names.natural_key) == ["m2a", "m2b", "m10b"]
    with pytest.raises(Exception, match="unknown task"):
        d.select(names.task_id(F.col("k"))).collect()
    for n, most in ((10, 3), (7, 7), (5, 0), (100, 9), (4, 3)):
        got = numeric.evenly_spaced(n, most)
        assert got == sorted(set(got)) and len(got) == (min(n, most) if most else n) and got[0] == 0 and got[-1] < n
    x = spark.createDataFrame([(-1.3,), (0.0,), (2.2,)], "x double")
    assert all(abs(r[1] - 0.5 * (1 + math.erf(r[0] / 2**0.5))) < 2e-7 for r in x.select("x", numeric.normal_cdf(F.col("x"))).collect())
    assert splitting.EMPTY == "(empty)"


def test_answers_beyond_ascii_and_registries(spark):
    d = spark.createDataFrame([("“Ｙｅｓ”",), ("Straße",), ("no’",)], "a string")
    reg = answers.Registry.of(["yes", "no", "strasse"])
    assert [r.label for r in answers.map_answers(d, "a", reg, ascii_only=False).collect()] == ["yes", "strasse", "no"]
    with pytest.raises(ValueError, match="stands for"):
        answers.Registry.of(["yes", "no"], {"no": ["YES!"]})
    for bad in ([], ["unclear"], ["/abs"], ["a/../b"]):
        with pytest.raises(ValueError):
            answers.Registry.of(bad)


def test_prompts_and_configs(spark, tmp_path):
    assert generation.prompt_map('{"cat": ["a", " "], "x": []}') == {"cat": ["a"]}
    assert generation.prompt_map('["cat"]') == {"cat": ["a photo of a cat"]} and generation.prompt_map("Cat: a; b") == {"cat": ["a", "b"]}
    for bad in ("", "  ", ",;"):
        with pytest.raises(ValueError):
            generation.prompt_map(bad)
    with pytest.raises(ValueError):
        generation.prompt_table({"a b": "x", "a_b": "y"})
    at = lambda n, t: (put(tmp_path / n, t), f"file://{tmp_path}/{n}")[1]
    assert configs.remap(spark, at("m.yaml", "merge: {x: [a]}\ndrop: [b]"))["merge"] == {"x": ["a"]}
    with pytest.raises(ValueError):
        configs.remap(spark, at("n.yaml", "other: 1"))
    assert configs.thresholds(spark, at("t.json", '{"a": 0.5}')) == {"a": 0.5}
    with pytest.raises(ValueError):
        configs.thresholds(spark, at("u.yaml", "a: 2"))
    assert configs.labels(spark, at("l.yaml", "cat: [y]\ndog: []")) == (["cat", "dog"], {"cat": ["y"], "dog": []})
    assert configs.prompts(spark, at("p.yaml", "cat: [a cat, kitten]")) == (["a cat", "kitten"], {"a cat": "cat", "kitten": "cat"})
    c = configs.filter_settings(spark, at("f.yaml", "global: {nms_iou: 0.5}\nper_class: {a: {det_conf: 0.3}}"))
    assert c.common == {"nms_iou": 0.5} and c.by_class == {"a": {"det_conf": 0.3}}
    with pytest.raises(ValueError):
        gates.Config({"odd": 1}, {})
    configs.write_document(spark, configs.stats_document("label", "x", "r", [], {"records": 1}, {"none": None}), f"file://{tmp_path}/s.yaml")
    assert "summary" not in (tmp_path / "s.yaml").read_text()
    with pytest.raises(FileExistsError):
        configs.write_document(spark, {}, f"file://{tmp_path}/s.yaml")
    assert arrange.manifest("arrange", "a", "b", {"x": None}, {"n": 1}) == {"version": 1, "branch": "prep", "command": "arrange", "src": "a", "dst": "b", "stats": {"n": 1}}


def test_providers_resume(spark):
    jobs = spark.range(20).select(F.col("id").cast("string").alias("job"), F.format_string("q%d", "id").alias("question"))
    stub = providers.provider("test", labels=("a", "b", "c"))
    name = f"stub-{random.random()}"
    first = providers.resumed(spark, jobs, stub, name, parts=2)
    assert first.count() == 20 and providers.resumed(spark, jobs, stub, name, parts=2).count() == 20
    assert {r.job: r.answer for r in first.collect()} == {r.job: r.answer for r in providers.run(jobs, stub, 3).collect()}
    with pytest.raises(KeyError, match="stub"):
        providers.provider("none")
    recs = spark.createDataFrame([(1, ["x"]), (2, [])], "id int, tags array<string>")
    res = spark.createDataFrame([(1, "j2", "b"), (1, "j1", "a")], "id int, job string, t string")
    assert {r.id: r.tags for r in providers.appended(recs, res, "id", "tags", F.col("t")).collect()} == {1: ["x", "a", "b"], 2: []}
    assert questions.prompts_of('{"l": ["q"]}') == [("q", "l")]


def test_pixels():
    rng = np.random.default_rng(0)
    x = rng.random((200, 240)) * 255
    assert abs(pixels.ssim(x, x) - 1) < 1e-9 and pixels.ssim(x, rng.random((200, 240)) * 255) < 0.1
    flat = np.full((40, 60, 3), 90, np.uint8)
    assert abs(pixels.thumb(flat).mean() - 90) < 1e-9 and pixels.sharpness(pixels.thumb(flat)) < 1e-12
    rgb = (rng.random((64, 64, 3)) * 255).astype(np.uint8)
    near = np.clip(rgb.astype(int) + 2, 0, 255).astype(np.uint8)
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert apart(pixels.perceptual_hash(rgb), pixels.perceptual_hash(near)) <= 6
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 0] = 200
    assert pixels.colour_shares(red)["red"] == 1 and pixels.colour_shares(red)["blue"] == 0
    square = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]])
    g = pixels.masked_geometry(square, np.array([0.0, 0, 4, 8]))
    assert g["mask_per_box"] == 0.5 and abs(g["mask_circularity"] - math.pi / 4) < 1e-9 and g["mask_solidity"] == 1


def test_clipped_polygons():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t = np.sort(rng.random(7)) * 2 * np.pi
        ring = np.stack([0.5 + 0.6 * np.cos(t), 0.5 + 0.6 * np.sin(t)], 1)
        out = geometry.clip(ring, np.array([0.2, 0.1, 0.8, 0.7]))
        area = abs(out[:, 0] @ np.roll(out[:, 1], -1) - out[:, 1] @ np.roll(out[:, 0], -1)) / 2 if len(out) else 0.0
        p = rng.random((40_000, 2)) * [0.6, 0.6] + [0.2, 0.1]
        q = np.roll(ring, -1, axis=0)
        inside = np.all([(b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= 0 for a, b in zip(ring, q)], axis=0)
        assert abs(area - inside.mean() * 0.36) < 0.01


def test_filters_are_learned(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], []
    for i in range(60):
        truth.append((i, 1, "a", 10.0, 10.0, 50.0, 50.0))
        rows.append((i, 1, "a", "det", float(0.6 + 0.4 * rng.random()), 11.0, 10.0, 51.0, 50.0))
        rows.append((i, 2, "a", "det", float(0.7 * rng.random()), 60.0, 60.0, 70.0 + i % 7, 65.0))
    s = "image int, ann int, label string, kind string, score double, x1 double, y1 double, x2 double, y2 double"
    pred = gates.box_features(spark.createDataFrame(rows, s), F.lit(100.0), F.lit(100.0))
    t = spark.createDataFrame(truth, "image int, ann int, label string, x1 double, y1 double, x2 double, y2 double")
    det, seg, best = gates.best_confidence(gates.confidence_grid(pred, t, ["image", "label"], grid=[0.0, 0.5, 0.6, 0.9]), 1.0)
    assert det in (0.5, 0.6) and seg is None and best > 0.85
    c = gates.train_config(pred, t, ["box_area_frac", "score"], tune=False)
    kept = matching.counts(matching.matched(gates.filtered(pred, c), t, ["image", "label"]), t).first()
    assert (kept.tp, kept.fp, kept.fn) == (60, 0, 0)
    fit = gates.fitted(pred.withColumn("y", (F.col("score") > 0.5).cast("int")).withColumn("noise", F.rand(1)), ["score", "noise"], "y")
    assert fit.p_values()["noise"] > 0.01
    assert gates.best_suppression(pred, t, "image", "label", grid=(0.3, 0.6))[0] in (0.3, 0.6)


def test_polygons_go_with_boxes(spark):
    s = "record_id int, ann long, kind string, label string, score double, group_id long, x1 double, y1 double, x2 double, y2 double"
    b = spark.createDataFrame([(1, 1, "det", "a", 0.9, None, 0.0, 0.0, 10.0, 10.0), (1, 2, "det", "a", 0.8, 7, 50.0, 50.0, 60.0, 60.0), (1, 3, "det", "b", 0.7, None, 0.0, 0.0, 10.0, 10.0)], s)
    p = spark.createDataFrame([(1, 4, "seg", "a", None, None, 0.0, 0.0, 10.0, 9.0), (1, 5, "seg", "z", None, 7, 0.0, 0.0, 1.0, 1.0), (1, 6, "seg", "c", 0.5, None, 3.0, 3.0, 4.0, 4.0)], s)
    got = {(r.box, r.polygon) for r in matching.with_polygons(b, p).collect()}
    assert got == {(1, 4), (2, 5), (3, None), (None, 6)}
    assert trust.rng(1, "a").random() == trust.rng(1, "a").random()
    assert isinstance(pd.Series([1]).iloc[0], np.int64)
