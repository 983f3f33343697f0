import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from orrery.operators import geometry
from orrery.sources import coco, files, labelme, sinks, yolo
from orrery.streaming import dedup


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_label_files_round_trip(spark, tmp_path):
    put(tmp_path / "det/train/a.txt", "0 0.5 0.5 0.2 0.4\n\n1 0.25 0.25 0.1 0.1\r\n")
    put(tmp_path / "det/train/b.txt", "")
    put(tmp_path / "seg/a.txt", "2 0.1 0.2 0.5 0.2 0.5 0.6")
    put(tmp_path / "pose/a.txt", "0 0.5 0.5 0.2 0.2 0.4 0.4 2 0.6 0.6 1\n")
    rows = sorted(yolo.read(spark, f"file://{tmp_path}/det").collect(), key=lambda r: r.ann)
    assert [(r.ann, r.kind, r.cls, r.cx, r.h) for r in rows] == [(1, "det", 0, 0.5, 0.4), (3, "det", 1, 0.25, 0.1)]
    seg = yolo.read(spark, f"file://{tmp_path}/seg").first()
    assert (seg.kind, seg.cls, seg.points) == ("seg", 2, [0.1, 0.2, 0.5, 0.2, 0.5, 0.6])
    assert [round(x, 9) for x in (seg.cx, seg.cy, seg.w, seg.h)] == [0.3, 0.4, 0.4, 0.4]
    pose = yolo.read(spark, f"file://{tmp_path}/pose", "pose")
    assert pose.first().points == [0.4, 0.4, 2, 0.6, 0.6, 1]
    assert yolo.to_lines(pose).first().text == "0 " + " ".join(f"{x:.6f}" for x in (0.5, 0.5, 0.2, 0.2, 0.4, 0.4, 2, 0.6, 0.6, 1))
    for bad in ("0 0.5 0.5", "0 x 0.5 0.2 0.2"):
        put(tmp_path / "bad/a.txt", bad)
        with pytest.raises(Exception, match="not a det line"):
            yolo.read(spark, f"file://{tmp_path}/bad", "det").collect()


@pytest.mark.parametrize("text,names", [("names: [a, b]", ["a", "b"]), ("names: {1: b, 0: a}", ["a", "b"]), ("path: x", [])])
def test_class_names(spark, tmp_path, text, names):
    put(tmp_path / "data.yaml", text)
    assert yolo.class_names(spark, f"file://{tmp_path}/data.yaml") == names


def document(**changes):
    return {
        "images": [{"id": 7, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 8, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [{"id": 1, "image_id": 7, "category_id": 9, "bbox": [10, 10, 20, 10], "segmentation": [[10, 10, 30, 10, 30, 20]]}],
        "categories": [{"id": 9, "name": "dog"}, {"id": 3, "name": "cat"}],
    } | changes


def test_documents_of_images_round_trip(spark, tmp_path):
    put(tmp_path / "one.json", json.dumps(document()))
    images, anns, classes = coco.read(spark, f"file://{tmp_path}/one.json")
    assert images.count() == 2
    assert {(r.cls, r.name) for r in classes.collect()} == {(0, "cat"), (1, "dog")}
    a = anns.first()
    assert (a.path, a.cls, a.cx, a.cy, a.w, a.h, a.polygons) == ("a.jpg", 1, 0.2, 0.3, 0.2, 0.2, [[0.1, 0.2, 0.3, 0.2, 0.3, 0.4]])
    src = images.selectExpr("'train' as split", "file_name as path", "width", "height")
    back = json.loads(coco.documents(src, anns, classes, "split").first().json)
    assert [x["file_name"] for x in back["images"]] == ["a.jpg", "b.jpg"]
    assert [round(x, 6) for x in back["annotations"][0]["bbox"]] == [10, 10, 20, 10]
    assert back["annotations"][0]["image_id"] == 1
    empty = json.loads(coco.documents(src, anns.where("false"), classes, "split").first().json)
    assert empty["annotations"] == []


@pytest.mark.parametrize("field,what", [("image_id", "image"), ("category_id", "category")])
def test_unknown_keys_fail(spark, tmp_path, field, what):
    doc = document()
    doc["annotations"][0][field] = 99
    put(tmp_path / "one.json", json.dumps(doc))
    with pytest.raises(ValueError, match=f"unknown {what}"):
        coco.read(spark, f"file://{tmp_path}/one.json")


def test_shapes(spark, tmp_path):
    shape = lambda label, kind, points: {"label": label, "shape_type": kind, "points": points}
    put(tmp_path / "x/a.json", json.dumps({"imagePath": "a.jpg", "imageWidth": 10, "imageHeight": 10, "shapes": [shape("b", "rectangle", [[5, 6], [1, 2]]), shape("a", "polygon", [[0, 0], [4, 0], [4, 3]])]}))
    put(tmp_path / "x/b.json", json.dumps({"imagePath": "b.jpg", "imageWidth": 10, "imageHeight": 10, "shapes": []}))
    d = labelme.read(spark, f"file://{tmp_path}/x")
    rows = {(r.path, r.ann): r for r in d.collect()}
    assert set(rows) == {("a.jpg", 1), ("a.jpg", 2), ("b.jpg", None)}
    r = rows["a.jpg", 1]
    assert (r.kind, r.x1, r.y1, r.x2, r.y2) == ("det", 1, 2, 5, 6)
    assert rows["a.jpg", 2].kind == "seg"
    assert [x.label for x in labelme.classes(d).orderBy("first").collect()] == ["b", "a"]


def test_class_folders(spark, tmp_path):
    for p in ("train/cat/1.jpg", "train/dog/1.jpg", "val/dog/2.JPG", "3.png", "cat/notes.txt"):
        put(tmp_path / p, "x")
    found = files.listing(spark, f"file://{tmp_path}")
    rows = {r.path: (r.split, r.classes) for r in files.class_folders(found).collect()}
    assert rows == {"train/cat/1.jpg": ("train", ["cat"]), "train/dog/1.jpg": ("train", ["dog"]), "val/dog/2.JPG": ("val", ["dog"]), "3.png": (None, [])}
    multi = {r.path: r.classes for r in files.class_folders(found, multi=True).collect()}
    assert multi["train/cat/1.jpg"] == ["cat", "dog"]
    put(tmp_path / "train/dog/1.jpg", "longer")
    with pytest.raises(Exception, match="differ"):
        files.class_folders(files.listing(spark, f"file://{tmp_path}"), multi=True).collect()


def test_key_tables(spark, tmp_path):
    put(tmp_path / "k.csv", "name,v\na,1\nb,2\n")
    assert files.key_table(spark, f"file://{tmp_path}/k.csv").count() == 2
    put(tmp_path / "k.csv", "name,v\na,1\na,2\n")
    with pytest.raises(ValueError, match="twice"):
        files.key_table(spark, f"file://{tmp_path}/k.csv")


def test_tar_shards(spark, tmp_path):
    def shard(name, members):
        with tarfile.open(tmp_path / name, "w") as tar:
            for n, b in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(b)
                tar.addfile(info, io.BytesIO(b))

    shard("0.tar", {"a.jpg": b"A", "a.json": b"{}", "b.png": b"B", "b.json": b"[]"})
    rows = {r.key: (r.ending, bytes(r.image), r.json) for r in files.read_shards(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a": ("jpg", b"A", "{}"), "b": ("png", b"B", "[]")}
    shard("1.tar", {"c.jpg": b"C"})
    with pytest.raises(Exception, match="not whole"):
        files.read_shards(spark, f"file://{tmp_path}").collect()


def test_shard_plan_keeps_both_bounds(spark):
    d = spark.range(1000).selectExpr("id", "cast(if(id = 500, 999, id % 7) as long) as b")
    rows = files.shard_plan(d, "id", "b", 20, 50).toPandas()
    assert sorted(rows["id"]) == list(range(1000))
    shard, n, total, want = 0, 0, 0, []
    for b in rows.sort_values("id")["b"]:
        if n and (n >= 20 or total + b > 50):
            shard, n, total = shard + 1, 0, 0
        n, total = n + 1, total + b
        want.append(shard)
    assert rows.sort_values("id")["shard"].tolist() == want


def test_differences_and_unions(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z"), (4, "x")], "k int, v string")
    assert {r.k: r.status for r in files.difference(a, b, "k", "v").collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}
    rows, vocabulary = files.union_sources([a, b], "v", "k")
    assert {r.v: r.cls for r in vocabulary.collect()} == {"x": 0, "y": 1, "z": 2}
    assert rows.count() == 6 and rows.where("cls is null").count() == 2


def test_streams_agree_with_tables(spark, tmp_path):
    rows = spark.range(200).selectExpr("cast(id % 20 as int) as k", "timestamp_seconds(id * 60) as ts")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")

    def ran(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert ran(dedup.first_by_key(stream, ["k"], "ts", "1 day"), "firsts", "append").count() == 20
    got = {(r.start, r.n) for r in ran(dedup.counts(stream, "ts", "1 hour", [], "1 day"), "counted", "complete").collect()}
    assert got == {(r.start, r.n) for r in dedup.counts(rows, "ts", "1 hour", []).collect()}


def test_files_are_written_once(spark, tmp_path):
    to = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a/1.txt", "x"), ("2.txt", None)], "path string, text string")
    assert sinks.write_files(rows, to) == 2
    assert (tmp_path / "out/a/1.txt").read_text() == "x" and (tmp_path / "out/2.txt").read_text() == ""
    with pytest.raises(FileExistsError):
        sinks.write_files(rows, to)
    assert sinks.write_files(rows.where("path = '2.txt'"), to, overwrite=True) == 1
    assert not (tmp_path / "out/a").exists()
    with pytest.raises(ValueError, match="twice"):
        sinks.write_files(rows.union(rows), to, overwrite=True)
    with pytest.raises(Exception, match="not below"):
        sinks.write_files(spark.createDataFrame([("../x", "")], "path string, text string"), to, overwrite=True)


def test_tar_shards_round_trip(spark, tmp_path):
    samples = spark.range(50).selectExpr("lpad(cast(id as string), 3, '0') as key", "'jpg' as ending", "cast(cast(id as string) as binary) as image", "to_json(struct(id)) as json")
    assert sinks.write_shards(samples, f"file://{tmp_path}/t", most_rows=9) >= 6
    back = files.read_shards(spark, f"file://{tmp_path}/t")
    assert {(r.key, bytes(r.image), r.json) for r in back.collect()} == {(r.key, bytes(r.image), r.json) for r in samples.collect()}


def test_geometry(spark):
    d = spark.range(1).select(
        geometry.crop(*(F.lit(x) for x in (-5.0, 2.5, 10.0, 4.0, 8, 6))).alias("cut"),
        geometry.crop(*(F.lit(x) for x in (20.0, 2.0, 3.0, 3.0, 8, 6))).alias("outside"),
        geometry.letterbox(F.lit(100.0), F.lit(50.0), 64, 64).alias("fit"),
        geometry.box_of_keypoints(F.expr("array(0.1D, 0.2D, 2D, 0.9D, 0.9D, 0D, 0.3D, 0.2D, 1D)"), 0.5).alias("seen"),
        geometry.box_of_keypoints(F.expr("array(0.1D, 0.2D, 0D)")).alias("unseen"),
        geometry.polygon_area(F.expr("array(0D, 0D, 4D, 0D, 4D, 3D)")).alias("area"),
        geometry.polygon_area(F.expr("array(0D, 0D)")).alias("none"),
    )
    r = d.first()
    assert tuple(r.cut) == (0, 2, 5, 6) and r.outside is None and r.unseen is None
    assert tuple(r.fit) == (0.64, 64, 32, 0, 16)
    assert [round(x, 9) for x in r.seen] == [0.2, 0.2, 0.4, 2e-6]
    assert (r.area, r.none) == (6.0, 0.0)
