"""Further registered queries: keys, selections, matching, geometry, files, trust, questions, providers, and whole chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.dataset import Dataset
from orrery.functions import keys, names, numeric
from orrery.functions.arrays import in_order
from orrery.operators import annotations as ann
from orrery.operators import arrange, gates, generation, geometry, ground, matching, negatives, profile, providers, questions, sampling, select, similarity, splitting, trust
from orrery.plans.catalog import SPLITS, _edges, _scored, query
from orrery.plans.views import V_BOXES, V_HASH, V_QAS, V_RECORDS, boxes, hashes, qas, records, table
from orrery.session import shared_dir
from orrery.sources import configs, files, folders, router

# a dataset of boxes on images


def dataset(spark, d) -> Dataset:
    """Boxes as a dataset: an image for each number, its split by the number, labels A, N and R."""
    b = boxes(spark, d)
    r = b.select(F.col("image").alias("record_id")).distinct()
    r = r.withColumns({"path": F.format_string("img_%06d.jpg", "record_id"), "split": F.when(F.col("record_id") % 5 == 0, "val").when(F.col("record_id") % 7 == 0, "test").otherwise("train"), "width": F.lit(1000), "height": F.lit(1000)})
    cls = F.expr("case label when 'A' then 0 when 'N' then 1 else 2 end")
    share = lambda c: F.col(c) / 1000
    a = b.select(F.col("image").alias("record_id"), "ann", F.lit("det").alias("kind"), cls.alias("cls"), "label", (share("x1") + share("w") / 2).alias("cx"), (share("y1") + share("h") / 2).alias("cy"), share("w").alias("w"), share("h").alias("h"), F.lit(None).cast("array<double>").alias("points"), "score", F.lit(None).cast("long").alias("group_id"))
    return Dataset(r, a, ("A", "N", "R"), "det", None)


V_IMAGES = "v_images AS (SELECT image, CASE WHEN image % 5 = 0 THEN 'val' WHEN image % 7 = 0 THEN 'test' ELSE 'train' END AS split, printf('img_%06d.jpg', image) AS path FROM (SELECT DISTINCT image FROM v_boxes))"
_rule = "CASE WHEN sqrt(w * h) < {0} THEN 'min_box' WHEN greatest(w, h) < {1} THEN 'min_side' END"


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# keys and names


@query(f"WITH {V_RECORDS} SELECT record_id, CAST(quality AS VARCHAR) AS key FROM v_records")
def key_attr(spark, d):
    r = records(spark, d).withColumn("attributes", F.create_map(F.lit("quality"), F.col("quality")))
    return r.select("record_id", keys.attr_key(F.col("attributes"), "quality").alias("key"))


@query(f"WITH {V_RECORDS} SELECT record_id, CASE WHEN record_id % 7 = 0 OR record_id % 11 = 0 THEN 'train' ELSE split END AS key FROM v_records")
def key_split(spark, d):
    s = F.when(F.col("record_id") % 7 == 0, "").when(F.col("record_id") % 11 == 0, None).otherwise(F.col("split"))
    return records(spark, d).select("record_id", keys.split_key(s).alias("key"))


@query(f"WITH {V_RECORDS} SELECT record_id, min(path) OVER (PARTITION BY grp) AS grp FROM v_records")
def group_by_key(spark, d):
    r = records(spark, d).select("record_id", "path", "split")
    return Dataset(r, folders.no_anns(spark)).groups(["dir:0"])


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' WHEN 3 THEN 'test' WHEN 4 THEN 'infer' WHEN 5 THEN 'train' WHEN 6 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_alias(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["train", "valid", " VAL", "eval", "infer", "", "Validation", "odd"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", names.split_id(raw).alias("split"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'det' WHEN 1 THEN 'inst-seg' WHEN 2 THEN 'pose' WHEN 3 THEN 'cls' WHEN 4 THEN 'multi-cls' ELSE NULL END AS task FROM documents")
def task_alias(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["Detection", "segment", "keypoints", "classification", "multi_label", " "])), (F.col("doc_id") % 6 + 1).cast("int"))
    raw = F.when(raw == "multi_label", "multi-label").otherwise(raw)
    return table(spark, d, "documents").select("doc_id", names.task_id(raw).alias("task"))


_head = "substr(text, 1, 40)"


@query(f"""WITH t AS (SELECT doc_id, {_head} AS t FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, t, regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS k FROM t)
  SELECT doc_id, CASE WHEN k = '' THEN 'sample' ELSE k END AS safe, CASE WHEN t = '' THEN 'unnamed' ELSE regexp_replace(t, '[/ ]', '_', 'g') END AS crop,
  CASE WHEN suffix(trim(lower(t)), '.') THEN trim(lower(t)) ELSE concat(trim(lower(t)), '.') END AS prompt FROM s""")
def safe_names(spark, d):
    """Names of the first 40 characters of texts, which is what a title is."""
    t = F.substring("text", 1, 40)
    return table(spark, d, "documents").where("text is not null").select("doc_id", names.safe(t).alias("safe"), names.crop_label(t).alias("crop"), names.prompt_text(t).alias("prompt"))


@query("""SELECT doc_id, concat(source, '__', lang, '__doc_', CAST(doc_id AS VARCHAR)) AS key, concat(replace(source, ' ', '_'), '/', lang) AS folder FROM documents""")
def sample_keys(spark, d):
    p = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", names.sample_key(p).alias("key"), names.label_folder(F.concat("source", F.lit("//"), "lang")).alias("folder"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN k ELSE concat(k, '#', CAST(n AS VARCHAR)) END AS key FROM (SELECT doc_id, source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def occurrence_numbers(spark, d):
    return names.numbered(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "key")


@query("SELECT doc_id, CASE WHEN n = 1 THEN k ELSE concat(k, '_', CAST(n - 1 AS VARCHAR)) END AS unique_key FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM (SELECT doc_id, concat('k', CAST(doc_id % 300 AS VARCHAR), 'x') AS k FROM documents))")
def unique_sample_keys(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id") % 300, F.lit("x")).alias("k"))
    return names.unique_keys(t, "k", "doc_id").select("doc_id", "unique_key")


@query(f"WITH {V_RECORDS} SELECT record_id, CAST(record_id AS DOUBLE) AS number, round(1.96 * sqrt(0.25 / record_id), 6) AS half, round(1 / (1 + exp(-(file_bytes % 7 - 3.0))), 9) AS sig FROM v_records WHERE record_id > 0")
def name_numbers(spark, d):
    r = records(spark, d).where("record_id > 0")
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return r.select("record_id", numeric.last_number(stem).alias("number"), F.round(numeric.half_width(F.col("record_id")), 6).alias("half"), F.round(numeric.sigmoid(F.col("file_bytes") % 7 - 3.0), 9).alias("sig"))


@query("""WITH z AS (SELECT p_partkey, (p_partkey % 801 - 400) / 100.0 AS x FROM part), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) AS t FROM z),
  e AS (SELECT *, 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x / 2) AS e FROM t)
  SELECT p_partkey, round(CASE WHEN x >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END, 7) AS cdf,
  CAST(least(100, greatest(5, round_even(CASE WHEN q <= 100 THEN (200 - q) / 2 ELSE 5000 / q END / 5, 0) * 5)) AS INTEGER) AS quality
  FROM (SELECT *, 100.0 * (1 + p_partkey % 250) / 57.625 AS q FROM e)""")
def numbers(spark, d):
    x = (F.col("p_partkey") % 801 - 400) / 100.0
    one = (F.lit(1) + F.col("p_partkey") % 250).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(numeric.normal_cdf(x), 7).alias("cdf"), numeric.jpeg_quality(F.array(one, one)).alias("quality"))


@query("SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute FROM events")
def minutes(spark, d):
    return table(spark, d, "events").select("event_id", numeric.minute_of(F.unix_timestamp("ts")).alias("minute"))


@query("SELECT p_partkey, greatest(1, CAST(ceil(0.5 * (p_size % 30)) AS INTEGER)) AS by_gap, greatest(1, CAST(floor(p_size / 8) AS INTEGER)) AS by_count, least(8, CAST(ceil(p_size / greatest(1, floor(p_size / 8))) AS INTEGER)) AS taken FROM part WHERE p_size % 30 > 0")
def frame_strides(spark, d):
    t = table(spark, d, "part").where("p_size % 30 > 0")
    size = F.col("p_size").cast("int")
    by_count = numeric.stride(size, F.lit(25.0), most=8)
    return t.select("p_partkey", numeric.stride(size, (size % 30).cast("double"), 8, 0.5).alias("by_gap"), by_count.alias("by_count"), F.size(numeric.frames_taken(size, by_count, 8)).alias("taken"))


# selection and classes


@query(f"WITH {V_BOXES} SELECT {_rule.format(80, 100)} AS rule, count(*) AS n FROM v_boxes GROUP BY 1")
def select_polygons(spark, d):
    b = boxes(spark, d)
    ring = F.array(F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1"), F.col("x1"), F.col("y1") + F.col("h"))
    e = select.extent(ring)
    rule = ann.size_rule(e["x2"] - e["x1"], e["y2"] - e["y1"], F.lit(1e6), 80, 100)
    return b.select(rule.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {V_BOXES} SELECT image, ann, x1 AS px FROM v_boxes")
def pose_pairing(spark, d):
    b = boxes(spark, d)
    k = b.select("image", (F.col("ann") * 10).alias("ann"), F.array("x1", "y1", F.lit(2.0)).alias("points"))
    return select.paired_poses(b.select("image", "ann"), k, "image").select("image", "ann", F.get("keypoints", 0).alias("px"))


@query(f"""WITH {V_BOXES}, r AS (SELECT * FROM v_boxes WHERE greatest(w, h) < 100)
  SELECT image, count(*) AS n FROM v_boxes s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image = s.image AND abs(r.x1 - s.x1) <= 0.001 AND abs(r.y1 - s.y1) <= 0.001 AND abs(r.x1 + r.w - s.x1 - s.w) <= 0.001 AND abs(r.y1 + r.h - s.y1 - s.h) <= 0.001) GROUP BY image""")
def shape_drop(spark, d):
    b = _edges(boxes(spark, d)).withColumn("shape_type", F.lit("rectangle")).withColumn("points", F.array("x1", "y1", "x2", "y2"))
    gone = b.where("greatest(w, h) < 100").withColumn("points", F.transform("points", lambda x: x + 0.0005))
    return select.drop_shapes(b.select("image", "shape_type", "points"), gone.select("image", "shape_type", "points"), "image").groupBy("image").agg(F.count("*").alias("n"))


@query(f"WITH {V_BOXES} SELECT image FROM v_boxes GROUP BY image HAVING max(w) >= 200")
def empty_policy_drop(spark, d):
    b = boxes(spark, d)
    return select.with_empty_policy(b.select("image").distinct(), b, b.where("w >= 200"), "drop", "image")


@query(f"WITH {V_BOXES} SELECT image, ann, CAST(CASE label WHEN 'A' THEN 0 ELSE 1 END AS INTEGER) AS cls, label FROM v_boxes WHERE label <> 'N'")
def drop_class_renumber(spark, d):
    s = dataset(spark, d)
    plan = select.keep_or_drop(list(s.classes), drop=["N"])
    return select.reindexed(s.anns, list(s.classes), plan).select(F.col("record_id").alias("image"), "ann", "cls", "label")


@query(f"WITH {V_BOXES} SELECT image, ann, CAST(CASE label WHEN 'R' THEN 1 ELSE 0 END AS INTEGER) AS cls, CASE label WHEN 'R' THEN 'rest' ELSE 'kept' END AS label FROM v_boxes")
def remap_plan(spark, d):
    s = dataset(spark, d).remap_classes(merge={"kept": ["A", "N"]}, others="rest")
    return s.anns.select(F.col("record_id").alias("image"), "ann", "cls", "label")


_abc = "p AS (SELECT doc_id, (doc_id * 7 % 100) / 100.0 AS a, (doc_id * 13 % 100) / 100.0 AS b, (doc_id * 29 % 100) / 100.0 AS c FROM documents), l AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label FROM p)"


def _labelled(spark, d):
    best = F.aggregate("probs", F.get("probs", 0), lambda m, x: F.when(x["score"] > m["score"], x).otherwise(m))
    return _scored(spark, d).withColumn("label", best["label"])


@query(f"WITH {_abc} SELECT doc_id, CASE WHEN label = 'c' THEN 'c' ELSE 'ab' END AS label, round(a + b, 6) AS ab, round(c, 6) AS c FROM l")
def remap_prob_sum(spark, d):
    plan = select.remap_plan(["a", "b", "c"], merge={"ab": ["a", "b"]})
    r = select.reindexed_labels(_labelled(spark, d), plan)
    of = lambda n: F.round(F.get(F.filter("probs", lambda p: p["label"] == n), 0)["score"], 6)
    return r.select("doc_id", "label", of("ab").alias("ab"), of("c").alias("c"))


@query(f"WITH {_abc} SELECT doc_id, CASE WHEN label <> 'b' THEN label WHEN a >= c THEN 'a' ELSE 'c' END AS label, 2 AS n FROM l")
def exclude_class(spark, d):
    r = select.pruned(_labelled(spark, d), ["b"])
    return r.select("doc_id", "label", F.size("probs").alias("n"))


@query(f"WITH {V_BOXES} SELECT label, count(*) AS n FROM (SELECT label, (image + ann) % 5 - 1 AS cls FROM v_boxes) WHERE cls < 0 OR cls >= 3 GROUP BY label")
def class_consistency(spark, d):
    b = boxes(spark, d).withColumn("cls", (F.col("image") + F.col("ann")) % 5 - 1)
    return select.inconsistent(b, ["A", "N", "R"]).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {V_RECORDS} SELECT record_id, concat(split, '2014') AS split FROM v_records WHERE split IN ('train', 'val')")
def split_prefix(spark, d):
    r = records(spark, d).select("record_id", F.concat("split", F.lit("2014")).alias("split"))
    return select.in_splits(r, "split", ["train", "val"], prefix=True)


@query(f"WITH {V_BOXES} SELECT image AS record_id FROM v_boxes GROUP BY image HAVING bool_or(kind = 'seg')")
def records_with_kind(spark, d):
    b = boxes(spark, d).withColumnRenamed("image", "record_id")
    return select.with_kinds(b.select("record_id").distinct(), b, ["seg"])


@query(f"WITH {V_RECORDS} SELECT record_id, path FROM v_records WHERE NOT regexp_matches(path, '^src1[0-9]*/') AND NOT regexp_matches(path, '_[0-9]*7\\.txt$')")
def exclude_names(spark, d):
    return select.without_names(records(spark, d), "path", ["^src1[0-9]*/", r"_[0-9]*7\.txt$"]).select("record_id", "path")


@query(f"WITH {V_RECORDS} SELECT 'zz' AS class UNION SELECT class FROM v_records WHERE class IS NOT NULL")
def class_universe(spark, d):
    return profile.class_universe(["zz"], records(spark, d), "class")


# filters


@query(f"""WITH {V_BOXES}, f AS (SELECT *, w * h / 1e6 AS a, least(w, h) / 1000 AS s, greatest(w, h) / least(w, h) AS r FROM v_boxes)
  SELECT image, ann, label FROM f WHERE CASE WHEN kind = 'seg' THEN score >= 0.93 WHEN label = 'R' THEN score >= 0.97 ELSE score >= 0.95 END
  AND CASE label WHEN 'A' THEN a >= 0.01 AND r <= 3 WHEN 'R' THEN s >= 0.05 ELSE TRUE END""")
def threshold_filter(spark, d):
    c = gates.Config({"det_conf": 0.95, "seg_conf": 0.93}, {"A": {"min_box_area_frac": 0.01, "max_ar": 3}, "R": {"det_conf": 0.97, "min_short_side_frac": 0.05}})
    b = gates.box_features(_edges(boxes(spark, d)), F.lit(1000.0), F.lit(1000.0)).where(gates.confident(c))
    keep = F.lit(True)
    for label, own in c.by_class.items():
        keep = F.when(F.col("label") == label, gates.within(own, b.columns)).otherwise(keep)
    return b.where(keep).select("image", "ann", "label")


@query(f"WITH {V_BOXES} SELECT image, ann FROM v_boxes WHERE CASE WHEN label = 'A' THEN 2 * (score - 0.95) / (0.03 + 1e-12) + 0.5 * (w - 120) / (57.0 + 1e-12) - 0.1 >= ln(0.6 / (1 - 0.6 + 1e-12) + 1e-12) ELSE score >= 0.96 END")
def logistic_gate(spark, d):
    g = gates.Gate(("score", "w"), (0.95, 120.0), (0.03, 57.0), (2.0, 0.5), -0.1, gates.Gate.log_odds(0.6))
    return gates.gated(boxes(spark, d), "label", {"A": g}, {"score": (0.96, None)}).select("image", "ann")


@query(f"WITH {V_BOXES} SELECT image, ann, round(w * h / 1e6, 9) AS area, round(least(w, h) / 1000, 9) AS short, round(greatest(w, h) / least(w, h), 9) AS ratio FROM v_boxes")
def detection_features(spark, d):
    b = gates.box_features(_edges(boxes(spark, d)), F.lit(1000.0), F.lit(1000.0))
    return b.select("image", "ann", F.round("box_area_frac", 9).alias("area"), F.round("short_side_frac", 9).alias("short"), F.round("aspect_ratio", 9).alias("ratio"))


@query(f"WITH {V_RECORDS} SELECT record_id, CASE WHEN split IN ('val', 'test') THEN 'val' ELSE 'train' END AS fold FROM v_records")
def training_split(spark, d):
    return gates.training_split(records(spark, d), "record_id", "split", 0.2).select("record_id", "fold")


@query(f"""WITH {V_BOXES}, t AS (SELECT count(*) FILTER (kind = 'seg') AS n FROM v_boxes) SELECT CASE WHEN label = 'A' THEN 'cat' ELSE label END AS label, count(*) AS n FROM v_boxes b
  JOIN (SELECT image, ann // 2 AS g, max(score) AS m FROM v_boxes GROUP BY 1, 2) g ON g.image = b.image AND g.g = b.ann // 2 WHERE m >= 0.95 AND score >= 0.95 GROUP BY 1""")
def ground_threshold(spark, d):
    b = _edges(boxes(spark, d)).withColumn("group_id", F.floor(F.col("ann") / 2))
    k = ground.kept(b.withColumnRenamed("image", "record_id"), 0.95, 0.0, {"A": "cat"})
    return k.groupBy("label").agg(F.count("*").alias("n"))


@query()
def ground_filter(spark, d):
    """Thresholds and suppression of grouped detections, and the class list."""
    b = _edges(boxes(spark, d)).withColumn("group_id", F.floor(F.col("ann") / 2)).withColumnRenamed("image", "record_id")
    kept, names_ = ground.with_classes(ground.kept(b, 0.95, 0.5, {"A": "cat"}), ["N"])
    return kept.select("record_id", "ann", "label", "cls").withColumn("classes", F.lit(len(names_)))


@query()
def gate_training(spark, d):
    """A filter learned from matches of half the boxes with the other half: a row for each class with its gate."""
    b = gates.box_features(_edges(boxes(spark, d)), F.lit(1000.0), F.lit(1000.0))
    c = gates.train_config(b.where("kind = 'det'"), b.where("kind = 'seg'"), ["box_area_frac", "aspect_ratio", "score"], least=0.3, tune=False)
    rows = [(k, g["logistic_gate"]["features"], [round(x, 6) for x in g["logistic_gate"]["weights"]], g["logistic_gate"]["threshold_type"]) for k, g in sorted(c.by_class.items())]
    return spark.createDataFrame(rows, "label string, features array<string>, weights array<double>, threshold string")


# matching

_sides = "iw := greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1))"
_inter = "(greatest(0, least(p.x1 + p.w, t.x1 + t.w) - greatest(p.x1, t.x1)) * greatest(0, least(p.y1 + p.h, t.y1 + t.h) - greatest(p.y1, t.y1)))"
_pairs = f"pairs AS (SELECT p.image, p.label, p.ann AS p, t.ann AS t, p.score, {_inter} / (p.w * p.h + t.w * t.h - {_inter}) AS iou FROM v_boxes p JOIN v_boxes t ON p.image = t.image AND p.label = t.label AND p.kind = 'det' AND t.kind = 'seg' WHERE {_inter} / (p.w * p.h + t.w * t.h - {_inter}) >= 0.3)"


def _taken(order: str) -> str:
    """Pairs taken in order while both ends are free, as a fold over each group's list."""
    return f"""g AS (SELECT image, label, list_transform(list({{'p': p, 't': t}} ORDER BY {order}), lambda x: [x]) AS l FROM pairs GROUP BY image, label),
  k AS (SELECT image, label, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.p = b[1].p OR x.t = b[1].t)) = 0 THEN list_concat(a, b) ELSE a END)) AS m FROM g)"""


@query(f"WITH {V_BOXES}, {_pairs}, {_taken('score DESC, p, iou DESC, t')} SELECT label, count(*) AS tp FROM k GROUP BY label")
def match_by_score(spark, d):
    b = _edges(boxes(spark, d))
    out = matching.matched_by_score(b.where("kind = 'det'"), b.where("kind = 'seg'"), ["image", "label"], 0.3)
    return out.where("tp").groupBy("label").agg(F.count("*").alias("tp"))


@query(f"""WITH {V_BOXES}, {_pairs}, {_taken('iou DESC, p, t')}, n AS (SELECT (SELECT count(*) FROM k) AS tp, count(*) FILTER (kind = 'det') AS p, count(*) FILTER (kind = 'seg') AS t FROM v_boxes),
  r AS (SELECT tp / p AS p, tp / t AS r FROM n) SELECT round(2 * p * r / (p + r), 9) AS f1, round(5 * p * r / (4 * p + r), 9) AS f2 FROM r""")
def micro_f(spark, d):
    b = _edges(boxes(spark, d))
    pred, truth = b.where("kind = 'det'"), b.where("kind = 'seg'")
    c = matching.counts(matching.matched(pred, truth, ["image", "label"], 0.3), truth)
    of = lambda x: F.round(matching.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), x), 9)
    return c.select(of(1.0).alias("f1"), of(2.0).alias("f2"))


@query(f"WITH {V_BOXES}, {_pairs} SELECT image, label, p AS ann, arg_min(t, (-iou, t)) AS other FROM pairs GROUP BY image, label, p")
def best_overlap(spark, d):
    b = _edges(boxes(spark, d))
    return matching.best_overlap(b.where("kind = 'det'"), b.where("kind = 'seg'"), ["image", "label"], 0.3).select("image", "label", "ann", "other")


@query(f"""WITH {V_BOXES} SELECT p.image, p.ann AS point, arg_min(b.ann, (b.w * b.h, b.ann)) AS box FROM v_boxes p JOIN v_boxes b ON p.image = b.image AND p.kind = 'det' AND b.kind = 'seg'
  AND p.x1 BETWEEN b.x1 AND b.x1 + b.w AND p.y1 BETWEEN b.y1 AND b.y1 + b.h GROUP BY p.image, p.ann""")
def point_in_box(spark, d):
    b = _edges(boxes(spark, d))
    pts = b.where("kind = 'det'").select("image", "ann", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return matching.inside(pts, b.where("kind = 'seg'"), "image")


@query()
def polygon_association(spark, d):
    """Boxes and the polygons that go with them, in the order of the boxes."""
    b = _edges(boxes(spark, d)).withColumn("group_id", F.when(F.col("ann") % 4 == 0, F.col("ann")))
    b = b.withColumnRenamed("image", "record_id")
    return matching.with_polygons(b.where("kind = 'det'"), b.where("kind = 'seg'")).select("record_id", "box", "polygon", "label")


@query("SELECT regexp_extract(url, '([^/]+?)$', 1) IS NOT NULL AS ok, count(*) AS n FROM pages GROUP BY 1")
def stems_of_urls(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("a/p"), "page_id", F.lit(".html")).alias("path"))
    q = table(spark, d, "pages").select(F.concat(F.lit("b/p"), "page_id", F.lit(".txt")).alias("path"))
    return matching.common_stems(p, q, "path").agg(F.count("*").alias("n")).select(F.lit(True).alias("ok"), "n")


@query("SELECT concat('p', CAST(page_id AS VARCHAR)) AS stem, concat('img/p', CAST(page_id AS VARCHAR), '.jpg') AS path_a, concat('lab/p', CAST(page_id AS VARCHAR), '.txt') AS path_b FROM pages WHERE page_id % 3 <> 0")
def images_to_labels(spark, d):
    p = table(spark, d, "pages")
    a = p.select(F.concat(F.lit("img/p"), "page_id", F.lit(".jpg")).alias("path"))
    b = p.where("page_id % 3 <> 0").select(F.concat(F.lit("lab/p"), "page_id", F.lit(".txt")).alias("path"))
    return matching.common_stems(a, b, "path")


@query("SELECT count(*) FILTER (page_id % 3 = 0) AS only_a, 0 AS only_b FROM pages")
def unmatched_stems(spark, d):
    p = table(spark, d, "pages")
    a = p.select(F.concat(F.lit("img/p"), "page_id", F.lit(".jpg")).alias("path"))
    b = p.where("page_id % 3 <> 0").select(F.concat(F.lit("lab/p"), "page_id", F.lit(".txt")).alias("path"))
    return matching.unmatched_stems(a, b, "path").select("only_a", F.col("only_b").cast("int").alias("only_b"))


@query("""SELECT CASE WHEN page_id % 2 = 0 THEN concat('set/', CAST(page_id AS VARCHAR), '.json') ELSE concat('labels/train/', CAST(page_id AS VARCHAR), '.json') END AS sidecar,
  CASE WHEN page_id % 2 = 0 THEN concat('set/', CAST(page_id AS VARCHAR), '.jpg') ELSE concat('images/train/', CAST(page_id AS VARCHAR), '.jpg') END AS image FROM pages""")
def sidecar_images(spark, d):
    p = table(spark, d, "pages")
    even = F.col("page_id") % 2 == 0
    s = p.select(F.concat(F.when(even, "set/").otherwise("labels/train/"), "page_id", F.lit(".json")).alias("path"))
    i = p.select(F.concat(F.when(even, "set/").otherwise("images/train/"), "page_id", F.lit(".jpg")).alias("path"))
    other = p.select(F.concat(F.lit("spare/"), "page_id", F.lit(".jpg")).alias("path"))
    return matching.ranked_candidates(s, i.unionAll(other))


@query(f"""WITH {V_BOXES}, a AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY x1, y1, w, h, ann) AS r FROM v_boxes),
  b AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY x1 + CASE WHEN ann % 10 = 0 THEN 0.01 ELSE 0.0005 END, y1, w, h, ann) AS r FROM v_boxes WHERE ann % 17 <> 0)
  SELECT coalesce(a.image, b.image) AS image, coalesce(a.label, b.label) AS label, a.ann, b.ann AS other FROM a FULL JOIN b ON a.image = b.image AND a.label = b.label AND a.r = b.r
  WHERE a.ann IS NULL OR b.ann IS NULL OR abs(a.x1 - b.x1 - CASE WHEN b.ann % 10 = 0 THEN 0.01 ELSE 0.0005 END) > 0.001 OR a.y1 <> b.y1 OR a.w <> b.w OR a.h <> b.h""")
def dataset_compare(spark, d):
    b = boxes(spark, d)
    new = b.where("ann % 17 <> 0").withColumn("x1", F.col("x1") + F.when(F.col("ann") % 10 == 0, 0.01).otherwise(0.0005))
    return matching.compared(b, new, "image", "label", ["x1", "y1", "w", "h"])


@query("SELECT a.doc_id, min(b.doc_id) AS source FROM documents a JOIN documents b ON sha1(a.text) = sha1(b.text) WHERE a.text IS NOT NULL GROUP BY a.doc_id")
def content_reference(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return t.join(t.groupBy("sha1").agg(F.min("doc_id").alias("source")), "sha1").select("doc_id", "source")


_vs = "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' WHEN a.lang IS NOT DISTINCT FROM b.lang THEN 'same' ELSE 'changed' END AS status"


@query(f"{_vs} FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 4) b ON a.doc_id = b.doc_id")
def dataset_difference(spark, d):
    """Two versions of a table, made of one by residues."""
    t = table(spark, d, "documents").select("doc_id", "lang")
    return files.difference(t.where("doc_id % 10 <> 3"), t.where("doc_id % 10 <> 4").withColumn("lang", F.expr("if(doc_id % 10 = 5, upper(lang), lang)")), "doc_id", "lang")


@query("(SELECT 'only_a' AS side, lang AS class FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT 'only_a', lang FROM documents WHERE doc_id % 2 = 1 AND lang <> 'de') UNION ALL (SELECT 'only_b', lang FROM documents WHERE doc_id % 2 = 1 AND lang <> 'de' EXCEPT SELECT 'only_b', lang FROM documents WHERE doc_id % 2 = 0)")
def class_difference(spark, d):
    t = table(spark, d, "documents")
    a, b = t.where("doc_id % 2 = 0").select("lang").distinct(), t.where("doc_id % 2 = 1 and lang <> 'de'").select("lang").distinct()
    side = lambda x, s: x.select(F.lit(s).alias("side"), F.col("lang").alias("class"))
    return side(a.exceptAll(b), "only_a").unionAll(side(b.exceptAll(a), "only_b"))


# geometry


@query(f"WITH {V_BOXES} SELECT image, ann, x1 + w / 2 AS cx, y1 + h / 2 AS cy, w * 1.5 AS w, h * 1.5 AS h FROM v_boxes")
def rebox_extent(spark, d):
    p = F.array(F.col("x1"), F.col("y1"), F.lit(2.0), F.col("x1") + F.col("w"), F.col("y1") + F.col("h"), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return boxes(spark, d).select("image", "ann", geometry.box_of_keypoints(p, 0.25).alias("b")).select("image", "ann", "b.*")


@query(f"""WITH {V_BOXES}, s AS (SELECT *, least(greatest(w * 1.5, h * 1.5) + 8, 950) AS s FROM v_boxes),
  p AS (SELECT *, least(greatest(x1 + w / 2 - s / 2, 0), 950 - s) AS l, least(greatest(y1 + h / 2 - s / 2, 0), 950 - s) AS t FROM s)
  SELECT image, ann, CAST(floor(l) AS BIGINT) AS "left", CAST(floor(t) AS BIGINT) AS top, CAST(floor(l + s) AS BIGINT) AS "right", CAST(floor(t + s) AS BIGINT) AS bottom FROM p""")
def crop_square(spark, d):
    c = [F.col(x) for x in ("x1", "y1", "w", "h")]
    return boxes(spark, d).select("image", "ann", geometry.square(*c, F.lit(950.0), F.lit(950.0), 0.25, 4.0).alias("c")).select("image", "ann", "c.*")


@query(f"WITH {V_BOXES} SELECT image, ann, round(greatest(0, least(x1 + w, 700) - greatest(x1, 200)) * greatest(0, least(y1 + h, 700) - greatest(y1, 200)), 6) AS area FROM v_boxes")
def polygon_clip(spark, d):
    x, y, r, b = F.col("x1"), F.col("y1"), F.col("x1") + F.col("w"), F.col("y1") + F.col("h")
    ring = F.array(x, y, r, y, r, b, x, b)
    lo, hi = F.lit(200.0), F.lit(700.0)
    return boxes(spark, d).select("image", "ann", F.round(geometry.clipped_area(ring, lo, lo, hi, hi), 6).alias("area"))


@query(f"WITH {V_BOXES}, {V_IMAGES} SELECT b.image, ann, concat(split, ':', path, ':box:', CAST(ann AS VARCHAR)) AS crop_id, split, path, 'box' AS kind, CAST(ann AS INTEGER) AS index FROM v_boxes b JOIN v_images i ON b.image = i.image")
def crop_ids(spark, d):
    s = dataset(spark, d)
    j = s.anns.join(s.records, "record_id").withColumn("crop_id", geometry.crop_id(F.col("split"), F.col("path"), F.lit("box"), F.col("ann"))).withColumn("p", geometry.parsed_crop_id(F.col("crop_id")))
    return j.select(F.col("record_id").alias("image"), "ann", "crop_id", "p.split", F.col("p.image").alias("path"), "p.kind", "p.index")


_round = "CAST(greatest(1, round_even({0} * {1}, 0)) AS BIGINT)"


@query(f"""WITH {V_BOXES}, s AS (SELECT image, ann, w, h, 224.0 / greatest(w, h) AS l, 100.0 / least(w, h) AS s FROM v_boxes)
  SELECT image, ann, {_round.format('w', 'l')} AS long_w, {_round.format('h', 'l')} AS long_h, {_round.format('w', 's')} AS short_w, {_round.format('h', 's')} AS short_h,
  CASE WHEN greatest(w, h) <= 224 THEN CAST(floor(w) AS BIGINT) ELSE {_round.format('w', 'l')} END AS cap_w FROM s""")
def resize_math(spark, d):
    b = boxes(spark, d)
    of = lambda mode, size: geometry.resized(F.col("w"), F.col("h"), mode, size)
    return b.select("image", "ann", of("long", 224)["w"].alias("long_w"), of("long", 224)["h"].alias("long_h"), of("short", 100)["w"].alias("short_w"), of("short", 100)["h"].alias("short_h"), of("cap-long", 224)["w"].alias("cap_w"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'exif' ELSE 'model' END AS method, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN 270 WHEN p_partkey % 4 = 2 THEN 180 ELSE 90 END AS INTEGER) AS ccw_degrees, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 8 = 0 ELSE p_partkey % 4 = 0 END AS unchanged FROM part")
def orientation(spark, d):
    tag = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 8 + 1)
    said = F.element_at(F.array(*map(F.lit, geometry.TURNS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", geometry.orientation(tag, said).alias("o")).select("p_partkey", "o.*")


_hex = "list_reduce(list_transform(string_split(substr(sha1({0}), 1, 8), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b)"


@query(f"""WITH {V_BOXES}, {V_IMAGES}, w AS (SELECT image, path, unnest(range(0, 2)) AS "window" FROM v_images), t AS (SELECT *, unnest(range(0, 20)) AS tried FROM w),
  c AS (SELECT *, {_hex.format("concat('0:', path, ':', CAST(\"window\" AS VARCHAR), ':', CAST(tried AS VARCHAR), ':x')")} % 901 AS x1, {_hex.format("concat('0:', path, ':', CAST(\"window\" AS VARCHAR), ':', CAST(tried AS VARCHAR), ':y')")} % 901 AS y1 FROM t),
  f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM v_boxes b WHERE b.image = c.image AND c.x1 < b.x1 + b.w AND b.x1 < c.x1 + 100 AND c.y1 < b.y1 + b.h AND b.y1 < c.y1 + 100))
  SELECT image, CAST("window" AS INTEGER) AS "window", arg_min(x1, tried) AS x1, arg_min(y1, tried) AS y1 FROM f GROUP BY image, "window" """)
def negatives_plan(spark, d):
    s = dataset(spark, d)
    r = s.records.select("record_id", F.col("path").alias("key"), "split", "width", "height")
    rects = _edges(boxes(spark, d)).select(F.col("image").alias("record_id"), "x1", "y1", "x2", "y2")
    return negatives.plan(r, rects, 100, per_image=2, tries=20).select(F.col("record_id").alias("image"), "window", "x1", "y1")


@query(f"WITH {V_BOXES} SELECT image, ann, CAST(row_number() OVER (PARTITION BY image ORDER BY w * h DESC, ann) AS INTEGER) AS step FROM v_boxes")
def paste_order(spark, d):
    b = boxes(spark, d)
    crops = matching.exactly_one(b, b.select("image").distinct().withColumn("there", F.lit(True)), ["image"], "crops")
    return matching.paste_order(crops, ["image"], F.col("w") * F.col("h"), "ann").select("image", "ann", "step")


@query("SELECT doc_id, quality = 1 AS good, TRUE AS seen, coalesce(toxic, 0) = 1 AS toxic FROM labels")
def merged_flags(spark, d):
    own = F.create_map(F.lit("good"), F.col("quality") != 1, F.lit("toxic"), F.col("toxic") == 1)
    crop = F.create_map(F.lit("good"), F.col("quality") == 1, F.lit("seen"), F.lit(True))
    m = table(spark, d, "labels").fillna(0, ["toxic"]).withColumn("m", matching.merged_flags(own, crop))
    return m.select("doc_id", *(F.col("m")[k].alias(k) for k in ("good", "seen", "toxic")))


# arranging files

_file = "concat(source, '/', lang, '/doc.', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END)"
V_FILES = f"v_files AS (SELECT doc_id, {_file} AS path, concat(source, '/', lang) AS dir, concat('doc.', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END) AS name FROM documents)"


def _files(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_file.replace("VARCHAR", "string")).alias("path"))


@query(f"WITH {V_FILES} SELECT doc_id, name AS plain, replace(path, '/', '__') AS prefix, concat('doc__', replace(dir, '/', '__'), substr(name, 4)) AS suffix FROM v_files")
def flatten_names(spark, d):
    p = F.col("path")
    return _files(spark, d).select("doc_id", *(arrange.flat_name(p, m).alias(n) for m, n in (("plain", "plain"), ("enc-prefix", "prefix"), ("enc-suffix", "suffix"))))


@query(f"WITH {V_FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN concat('non_images/', name) ELSE name END AS \"to\" FROM v_files")
def route_non_images(spark, d):
    f = _files(spark, d).withColumn("to", arrange.flat_name(F.col("path"), "plain"))
    return arrange.routed(f, "collect").select("doc_id", "to")


@query(f"WITH {V_FILES}, i AS (SELECT doc_id, lpad(CAST(row_number() OVER (ORDER BY path) + 100 AS VARCHAR), 6, '0') AS n FROM v_files WHERE doc_id % 3 < 2) SELECT v.doc_id, CASE WHEN n IS NULL THEN replace(path, '/', '__') ELSE concat(replace(dir, '/', '__'), '__', n, CASE v.doc_id % 3 WHEN 0 THEN '.jpg' ELSE '.png' END) END AS \"to\" FROM v_files v LEFT JOIN i ON v.doc_id = i.doc_id")
def rename_images(spark, d):
    f = _files(spark, d).withColumn("to", arrange.flat_name(F.col("path"), "enc-prefix"))
    return arrange.renumbered(f, "enc-prefix", 101).select("doc_id", "to")


@query("SELECT max(doc_id) + 1 AS next FROM documents WHERE doc_id % 2 = 0")
def next_number(spark, d):
    e = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("x/a__"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png")).alias("path"))
    return spark.createDataFrame([(arrange.next_number(e, "enc-prefix"),)], "next long")


@query(f"WITH {V_FILES} SELECT CASE WHEN doc_id % 3 = 2 THEN 'drop' ELSE 'link' END AS kind, path AS src, CASE WHEN doc_id % 3 < 2 THEN concat('out/', name) END AS dst, CASE WHEN doc_id % 3 = 2 THEN 'non-image' END AS reason FROM v_files")
def action_plan(spark, d):
    f = _files(spark, d).withColumn("to", arrange.flat_name(F.col("path"), "plain")).withColumn("drop", F.when(~arrange.is_image(F.col("path")), "non-image"))
    return arrange.actions(f, "hard", "out")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) GROUP BY text")
def dedup_against_destination(spark, d):
    """Residues of the id stand for what the destination holds already."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").alias("size"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return arrange.new_files(t.where("doc_id % 4 <> 0"), t.where("doc_id % 4 = 0")).select("doc_id")


@query("SELECT doc_id, CASE WHEN n = 0 THEN concat(lang, '.txt') ELSE concat(lang, '_', CAST(n AS VARCHAR), '.txt') END AS \"to\" FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents WHERE lang IS NOT NULL)")
def placed_flat(spark, d):
    t = table(spark, d, "documents").where("lang is not null").select("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), "lang", F.lit(".txt")).alias("path"))
    return arrange.placed_flat(t).select("doc_id", "to")


@query("SELECT key FROM (SELECT concat('0:', CAST(doc_id AS VARCHAR)) AS key FROM documents UNION ALL SELECT concat('1:', CAST(page_id AS VARCHAR)) FROM pages) ORDER BY sha1(concat('3:', key)), key LIMIT 40")
def pooled_sample(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    b = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"))
    return sampling.take(arrange.pooled_keys([a, b]), "key", 40, seed=3).select("key")


# trust

_twins = f"{V_HASH}, b AS (SELECT q.vec_id AS q, arg_min(r.vec_id, (bit_count(xor(q.h, r.h)), r.vec_id)) AS r, CAST(64 - min(bit_count(xor(q.h, r.h))) AS INTEGER) AS score FROM v_hash q CROSS JOIN v_hash r WHERE q.split = 'test' AND r.split = 'train' GROUP BY q.vec_id), c AS (SELECT *, row_number() OVER (ORDER BY score DESC, q) - 1 AS rank, count(*) OVER () AS n FROM b)"


def _ranked(spark, d):
    h = hashes(spark, d)
    t = trust.twins(h.where("split = 'test'"), h.where("split = 'train'"), "vec_id", "h")
    return trust.rank_curve(t)


@query(f"WITH {_twins} SELECT q, r, score, rank, round(100.0 * rank / (n - 1), 6) AS percent FROM c")
def twin_rank(spark, d):
    return _ranked(spark, d).select("q", "r", "score", "rank", F.round("percent", 6).alias("percent"))


@query(f"WITH {_twins}, e AS (SELECT unnest([0, 1, 5, 25, 75]) AS p), w AS (SELECT min(p) AS example, pos FROM (SELECT p, CAST(round_even(p / 100.0 * ((SELECT max(n) FROM c) - 1), 0) AS BIGINT) AS pos FROM e) GROUP BY pos) SELECT q, CAST(example AS INTEGER) AS example FROM c JOIN w ON rank = pos")
def twin_examples(spark, d):
    return trust.at_percents(_ranked(spark, d)).select("q", "example")


@query(f"WITH {V_HASH}, s AS (SELECT vec_id, h, row_number() OVER (ORDER BY sha1(concat('0:', CAST(vec_id AS VARCHAR))), vec_id) AS at FROM v_hash), n AS (SELECT count(*) FILTER (split = 'test') AS n FROM v_hash), b AS (SELECT q.vec_id, 64 - min(bit_count(xor(q.h, r.h))) AS score FROM s q CROSS JOIN s r CROSS JOIN n WHERE q.at <= n AND r.at > n GROUP BY 1) SELECT 'test' AS split, round(avg(CAST(score >= 44 AS INTEGER)), 6) AS share, count(*) AS n FROM b")
def twin_baseline(spark, d):
    return trust.baseline(hashes(spark, d), "vec_id", "h", "split", 44).select("split", F.round("share", 6).alias("share"), "n")


@query(f"WITH {V_RECORDS} SELECT record_id, row_number() OVER (ORDER BY concat('doc_', CAST(record_id AS VARCHAR)), path) - 1 AS file_index FROM v_records")
def file_index(spark, d):
    return trust.file_index(records(spark, d).select("record_id", "path"), "path").select("record_id", F.col("file_index").cast("long").alias("file_index"))


@query(f"WITH {V_RECORDS}, s AS (SELECT grp, CAST(row_number() OVER (ORDER BY count(*) DESC, grp) AS INTEGER) AS b FROM v_records WHERE split = 'train' GROUP BY grp) SELECT record_id, coalesce(b, 0) AS bin FROM v_records LEFT JOIN s USING (grp)")
def category_bins(spark, d):
    return trust.category_bins(records(spark, d), "grp", F.col("split") == "train").select("record_id", "bin")


@query(f"""WITH {V_RECORDS}, i AS (SELECT unnest(range(0, 3)) AS i), f AS (SELECT i, record_id, grp, class, row_number() OVER (PARTITION BY i ORDER BY sha1(concat('0:', CAST(i AS VARCHAR), ':a:', CAST(record_id AS VARCHAR))), record_id) AS a, row_number() OVER (PARTITION BY i ORDER BY sha1(concat('0:', CAST(i AS VARCHAR), ':b:', CAST(record_id AS VARCHAR))), record_id) AS b FROM v_records, i WHERE split = 'train'),
  m AS (SELECT x.i, x.grp, y.class FROM f x JOIN f y ON x.i = y.i AND x.a = y.b), s AS (SELECT i, class, count(*) AS n FROM m GROUP BY i, class),
  r AS (SELECT m.i, grp, m.class, count(*) / any_value(s.n) AS share FROM m JOIN s ON m.i = s.i AND m.class = s.class GROUP BY m.i, grp, m.class),
  k AS (SELECT i, grp, arg_min(class, (-share, class)) AS named FROM r GROUP BY i, grp), u AS (SELECT i, arg_min(class, (-n, class)) AS usual FROM s GROUP BY i),
  p AS (SELECT u.i, v.class, avg(CAST(coalesce(named, usual) = v.class AS INTEGER)) AS recall FROM v_records v CROSS JOIN u LEFT JOIN k ON k.i = u.i AND k.grp = v.grp WHERE split <> 'train' GROUP BY u.i, v.class),
  o AS (SELECT i, round(avg(recall), 6) AS b FROM p GROUP BY i) SELECT round(avg(b), 6) AS floor FROM o""")
def shuffled_floor(spark, d):
    return trust.shuffled_floor(records(spark, d).select("record_id", "grp", "class", "split"), "grp", "class", "record_id", F.col("split") == "train", 3)


@query()
def forward_selection(spark, d):
    r = profile.quartile_bins(records(spark, d), "file_bytes", F.col("split") == "train", "size")
    r = trust.category_bins(r, "grp", F.col("split") == "train", "source")
    steps = trust.forward_selection(r, ["size", "source"], "class", F.col("split") == "train")
    return spark.createDataFrame(steps, "step int, cue string, accuracy double")


@query(f"WITH {V_RECORDS}, n AS (SELECT class, count(*) AS n FROM v_records GROUP BY class), t AS (SELECT DISTINCT class FROM ((SELECT class FROM n ORDER BY n DESC, class LIMIT 2) UNION ALL (SELECT class FROM n ORDER BY n, class DESC LIMIT 2))) SELECT record_id, class FROM v_records JOIN t USING (class) QUALIFY row_number() OVER (PARTITION BY class ORDER BY sha1(concat('0:', CAST(record_id AS VARCHAR))), CAST(record_id AS VARCHAR)) <= 12")
def class_examples(spark, d):
    return trust.class_examples(records(spark, d), "class", "record_id", 2).select("record_id", "class")


@query(f"WITH {V_RECORDS} (SELECT record_id, 'largest' AS extreme FROM v_records ORDER BY file_bytes DESC, path DESC LIMIT 6) UNION ALL (SELECT record_id, 'smallest' FROM v_records ORDER BY file_bytes, path LIMIT 6)")
def extremes(spark, d):
    return trust.extremes(records(spark, d), "file_bytes", "path").select("record_id", "extreme")


@query(f"""WITH {V_RECORDS}, r AS (SELECT record_id, class, row_number() OVER (PARTITION BY class ORDER BY sha1(concat('5:', CAST(record_id AS VARCHAR))), record_id) - 1 AS at, count(*) OVER (PARTITION BY class) AS n FROM v_records),
  c AS (SELECT DISTINCT class, n FROM r), w AS (SELECT class, n, unnest(range(1, 41)) AS draw FROM c), h AS (SELECT class, draw, {_hex.format("concat('5:', class, ':', CAST(draw AS VARCHAR))")} % n AS at FROM w)
  SELECT h.class, CAST(draw AS INTEGER) AS draw, record_id FROM h JOIN r ON r.class = h.class AND r.at = h.at""")
def sample_with_replacement(spark, d):
    r = records(spark, d)
    targets = r.select("class").distinct().withColumn("target", F.lit(40))
    return trust.with_replacement(r, "record_id", "class", targets, 5).select("class", "draw", "record_id")


# splits


@query("SELECT doc_id AS record, lang AS stratum, CAST(1 AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, '(empty)', 1 FROM documents WHERE lang IS NULL")
def class_weights(spark, d):
    t = table(spark, d, "documents")
    return splitting.class_weights(t, t, "doc_id", "lang")


@query(f"WITH {V_BOXES} SELECT image AS record, concat(label, '|', CASE WHEN sqrt(w * h) < 64 THEN '<64' WHEN sqrt(w * h) < 128 THEN '64-128' ELSE '>=128' END) AS stratum, count(*) AS n FROM v_boxes GROUP BY 1, 2")
def class_size_weights(spark, d):
    b = boxes(spark, d)
    return splitting.class_size_weights(b.select("image").distinct(), b, "image", "label", F.col("w"), F.col("h"), [64, 128])


@query(f"WITH {V_RECORDS} SELECT grp, coalesce(class, '(empty)') AS stratum, count(*) AS n FROM v_records GROUP BY 1, 2")
def group_counts(spark, d):
    r = records(spark, d)
    w = splitting.class_weights(r, r, "record_id", "class")
    return splitting.group_counts(w, r.select(F.col("record_id").alias("record"), "grp"))


@query(f"WITH {V_BOXES} SELECT image AS record_id, label, count(*) AS n FROM v_boxes WHERE kind <> 'seg' GROUP BY 1, 2")
def record_labels(spark, d):
    b = boxes(spark, d).withColumnRenamed("image", "record_id").withColumn("cls", F.lit(0))
    return splitting.record_labels(b).groupBy("record_id", "label").agg(F.count("*").alias("n"))


def _facts(d: DataFrame, group: str, split: str) -> DataFrame:
    pure = d.groupBy(group).agg(F.countDistinct(split).alias("n")).agg((F.max("n") == 1).alias("pure"))
    return d.agg(F.count("*").alias("rows"), F.count(split).alias("placed")).join(F.broadcast(pure))


@query("SELECT count(*) AS rows, count(*) AS placed, TRUE AS pure, TRUE AS near FROM documents")
def split_facts(spark, d):
    """A split of records whose text decides the group: rows, groups that stay whole, and shares of classes within a twentieth."""
    r = records(spark, d).withColumn("g", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    s = splitting.split(r.drop("split"), "g", "class", {"train": 0.7, "val": 0.15, "test": 0.15})
    share = s.groupBy("class").agg(*(F.avg((F.col("split") == k).cast("double")).alias(k) for k in SPLITS))
    near = share.agg(F.max(F.greatest(F.abs(F.col("train") - 0.7), F.abs(F.col("val") - 0.15), F.abs(F.col("test") - 0.15)) <= 0.05).alias("a"), F.min(F.greatest(F.abs(F.col("train") - 0.7), F.abs(F.col("val") - 0.15), F.abs(F.col("test") - 0.15)) <= 0.05).alias("near"))
    return _facts(s, "g", "split").join(F.broadcast(near.select("near")))


@query("SELECT count(*) AS rows, count(*) AS placed, TRUE AS pure, TRUE AS pinned FROM documents")
def split_pin_facts(spark, d):
    r = records(spark, d).withColumn("pin", F.when(F.col("grp") == "src3", "test"))
    s = splitting.split(r.drop("split"), "grp", "class", {"train": 0.8, "val": 0.1, "test": 0.1}, pinned="pin")
    held = s.agg(F.coalesce(F.min(F.col("pin").isNull() | (F.col("split") == F.col("pin"))), F.lit(True)).alias("pinned"))
    return _facts(s, "grp", "split").join(F.broadcast(held))


@query("SELECT count(*) AS rows, TRUE AS tested_once, 4 AS folds FROM documents")
def fold_facts(spark, d):
    """Four folds: every record is tested in exactly one."""
    s = splitting.fold_splits(records(spark, d), "grp", "class", 4, 0.2)
    once = F.size(F.filter("fold_splits", lambda x: x == "test")) == 1
    return s.agg(F.count("*").alias("rows"), F.min(once).alias("tested_once"), F.max(F.size("fold_splits")).alias("folds"))


@query("SELECT doc_id, fold FROM (SELECT doc_id, unnest(range(0, 3)) AS fold FROM documents)")
def fold_fan_out(spark, d):
    t = table(spark, d, "documents").withColumn("fold_splits", F.array(*map(F.lit, SPLITS)))
    return splitting.fan_out(t).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query(f"WITH {V_RECORDS}, h AS (SELECT DISTINCT grp FROM v_records WHERE record_id % 97 = 0) SELECT record_id FROM v_records WHERE record_id % 97 = 0 OR grp NOT IN (SELECT grp FROM h)")
def siblings_drop(spark, d):
    r = records(spark, d).withColumn("pin", F.when(F.col("record_id") % 97 == 0, "test"))
    return splitting.drop_siblings(r, "grp", "pin").select("record_id")


# questions, prompts, providers

_qa = f"WITH {V_QAS}"


def _asked(spark, d):
    none = lambda t: F.lit(None).cast(t)
    q = F.struct(F.col("question"), F.when(F.col("turn") % 4 == 1, "").otherwise(F.col("answer")).alias("answer"), none("double").alias("score"), F.lit("m").alias("model"), F.col("turn").cast("string").alias("id"), none("string").alias("label"), none("string").alias("ground_truth"), none("array<string>").alias("expected"), F.lit("chat").alias("source"), none("map<string,string>").alias("meta")).cast(questions.QA)
    rows = qas(spark, d).select("conv_id", "turn", q.alias("qa")).groupBy("conv_id").agg(in_order(F.collect_list(F.struct("turn", "qa")), "turn").alias("l"))
    return rows.select("conv_id", F.transform("l", lambda x: x["qa"]).alias("qas"))


@query(f"{_qa}, n AS (SELECT conv_id, count(*) AS n FROM v_qas GROUP BY conv_id) SELECT conv_id, CAST(n + 2 AS INTEGER) AS n FROM n")
def seed_questions(spark, d):
    out = questions.with_questions(_asked(spark, d), [("what is it?", None), ("what is it?", None), ("why?", "reason")])
    return questions.with_questions(out, [("why?", "reason")]).select("conv_id", F.size("qas").alias("n"))


@query(f"{_qa}, p AS (SELECT conv_id, turn, question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM v_qas) SELECT concat('record:', CAST(conv_id AS VARCHAR), ':qa:', CAST(j AS VARCHAR)) AS job, conv_id AS record, question FROM p WHERE turn % 4 = 1 AND trim(question) <> ''")
def vlm_jobs(spark, d):
    return questions.jobs(_asked(spark, d), "conv_id", ["unused"])


@query(f"{_qa} SELECT conv_id, CAST(turn AS VARCHAR) AS id, question, CASE WHEN turn % 4 = 1 THEN '' ELSE answer END AS answer, 'chat' AS source FROM v_qas WHERE trim(question) = question AND question <> ''")
def qa_round_trip(spark, d):
    """Questions written as a file's entries and read from them again."""
    e = _asked(spark, d).select("conv_id", F.explode("qas").alias("q")).where("trim(q.question) = q.question and q.question <> ''")
    back = e.select("conv_id", questions.decoded(F.from_json(questions.encoded(F.col("q")), questions.PAYLOAD)).alias("q"))
    return back.select("conv_id", "q.id", "q.question", "q.answer", "q.source")


@query(f"{_qa} SELECT concat('c', CAST(conv_id AS VARCHAR), '__qid', CAST(turn AS VARCHAR)) AS key FROM v_qas")
def answers_apart(spark, d):
    t = _asked(spark, d).withColumn("key", F.concat(F.lit("c"), "conv_id"))
    return questions.by_answer(t).select("key")


@query("SELECT * FROM (VALUES (0, 'cat', 'a cat', 1, 'cat_0001'), (0, 'cat', 'a cat', 2, 'cat_0002'), (1, 'big_dog', 'a dog', 1, 'big_dog_0001'), (1, 'big_dog', 'a dog', 2, 'big_dog_0002')) AS t(prompt_index, prompt_id, prompt, sample, key)")
def prompt_create(spark, d):
    return generation.created(spark, {"cat": "a cat", "big dog": "a dog"}, 2)


def _edited(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("record_number"), F.concat(F.lit("x/Doc "), "doc_id", F.lit(".PNG")).alias("path"))
    return generation.edited(r, ["a cat", "a dog"], 2)


@query("SELECT doc_id AS record_number, CAST(p AS INTEGER) AS prompt_index, CAST(s AS INTEGER) AS sample, concat('000', CAST(p AS VARCHAR), '_', printf('%04d', doc_id), '_doc_', CAST(doc_id AS VARCHAR), '_000', CAST(s AS VARCHAR)) AS key FROM documents, (SELECT unnest([0, 1]) AS p), (SELECT unnest([1, 2]) AS s)")
def prompt_edit(spark, d):
    return _edited(spark, d).select("record_number", "prompt_index", "sample", "key")


@query("SELECT count(*) * 4 AS generated_images, count(*) AS sources, CAST(2 AS BIGINT) AS prompt_count, CAST(2 AS BIGINT) AS images_per_prompt FROM documents")
def generation_stats(spark, d):
    return generation.statistics(_edited(spark, d))


@query("SELECT kind, count(*) AS n FROM (SELECT 'move' AS kind FROM documents, range(4) UNION ALL SELECT 'copy' FROM documents) GROUP BY kind")
def generated_places(spark, d):
    g = _edited(spark, d).withColumn("file", F.concat(F.lit("tmp/"), "key", F.lit(".png")))
    return generation.placed(g).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_qa}, h AS (SELECT conv_id, turn, sha256(question) AS h FROM v_qas) SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS job, CASE WHEN substr(h, 1, 2) >= substr(h, 3, 2) THEN 'a' ELSE 'b' END AS answer FROM h")
def provider_answers(spark, d):
    """A stub model over all questions, in batches."""
    j = qas(spark, d).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("job"), "question")
    return providers.run(j, providers.provider("test")).select("job", "answer")


@query(f"WITH {_abc} SELECT doc_id, CASE WHEN greatest(a, b, c) >= 0.7 THEN label END AS label, greatest(a, b, c) AS score FROM l")
def classification_store(spark, d):
    return providers.classified(_scored(spark, d), 0.7).select("doc_id", "label", "score")


# health and statistics


@query(f"""WITH {V_BOXES}, {V_IMAGES}, f AS (SELECT 'boxes_outside_image' AS "check", image FROM v_boxes WHERE x1 < -1 OR y1 < -1 OR x1 + w > 951 OR y1 + h > 951 UNION SELECT 'zero_area_boxes', image FROM v_boxes WHERE w <= 0 OR h <= 0
  UNION SELECT 'class_id_out_of_range', image FROM v_boxes WHERE (image + ann) % 5 - 1 < 0 OR (image + ann) % 5 - 1 >= 3 UNION SELECT 'images_without_annotations', image FROM v_images WHERE image NOT IN (SELECT image FROM v_boxes WHERE w > 60)
  UNION SELECT 'unreadable_or_zero_size_images', image FROM v_images WHERE image % 100 = 0), r AS (SELECT "check", path, row_number() OVER (PARTITION BY "check" ORDER BY path) AS r FROM f JOIN v_images i ON i.image = f.image),
  n AS (SELECT unnest(['boxes_outside_image', 'zero_area_boxes', 'class_id_out_of_range', 'images_without_annotations', 'unreadable_or_zero_size_images']) AS "check")
  SELECT n."check", count(path) AS count, coalesce(string_agg(path, ';' ORDER BY path) FILTER (r <= 10), '') AS examples FROM n LEFT JOIN r ON r."check" = n."check" GROUP BY 1""")
def health_table(spark, d):
    s = dataset(spark, d)
    path = s.records.select(F.col("record_id").alias("image"), "path")
    b = boxes(spark, d).join(path, "image")
    r = s.records.withColumn("width", F.when(F.col("record_id") % 100 == 0, 0).otherwise(F.col("width")))
    odd = select.inconsistent(b.withColumn("cls", (F.col("image") + F.col("ann")) % 5 - 1), ["A", "N", "R"])
    checks = {"boxes_outside_image": profile.outside(b, 950, 950), "zero_area_boxes": profile.zero_area(b), "class_id_out_of_range": odd, "images_without_annotations": profile.unannotated(path, boxes(spark, d).where("w > 60"), "image"), "unreadable_or_zero_size_images": profile.unreadable(r)}
    return profile.health({k: v.select("path") for k, v in checks.items()})


@query(f"WITH {V_RECORDS}, u AS (SELECT DISTINCT grp FROM v_records), s AS (SELECT DISTINCT split FROM v_records WHERE split <> 'train'), m AS (SELECT split, grp FROM u CROSS JOIN s EXCEPT SELECT split, grp FROM v_records) SELECT split, count(*) AS classes, string_agg(grp, ';' ORDER BY grp) AS names FROM m GROUP BY split")
def missing_names(spark, d):
    return profile.missing_names(records(spark, d), "grp", "split")


@query(f"WITH {V_BOXES} SELECT CAST((w / h >= 0.5)::INT + (w / h >= 1)::INT + (w / h >= 2)::INT AS INTEGER) AS bin, count(*) AS n FROM v_boxes GROUP BY 1")
def aspect_histogram(spark, d):
    return profile.aspect_histogram(boxes(spark, d), F.col("w"), F.col("h"), [0.5, 1.0, 2.0])


@query(f"WITH {V_BOXES}, n AS (SELECT concat(CAST(CAST(w AS BIGINT) AS VARCHAR), 'x', CAST(CAST(h AS BIGINT) AS VARCHAR)) AS value, count(*) AS n FROM v_boxes GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r FROM n) SELECT value, n FROM r WHERE r <= 20 UNION ALL SELECT concat('other (', CAST(count(*) AS VARCHAR), ')'), CAST(sum(n) AS BIGINT) FROM r WHERE r > 20 HAVING count(*) > 0")
def resolution_mix(spark, d):
    b = boxes(spark, d).select(F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))
    return profile.resolutions(b, "w", "h")


@query(f"WITH {V_RECORDS}, n AS (SELECT split, count(*) AS n FROM v_records GROUP BY split) SELECT split, n, CAST(row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, split) AS INTEGER) AS place FROM n")
def split_counts(spark, d):
    n = records(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(names.split_rank(F.col("split")))))  # a row for each split


# chains and files


@query(f"""WITH {V_BOXES}, {V_IMAGES}, k AS (SELECT image, count(*) AS n FROM v_boxes WHERE {_rule.format(80, 100)} IS NULL GROUP BY image), r AS (SELECT i.image, split, coalesce(n, 0) AS n FROM v_images i LEFT JOIN k ON k.image = i.image)
  SELECT split, count(*) AS images, count(*) FILTER (n > 0) AS annotated, count(*) FILTER (n = 0) AS empty, CAST(sum(n) AS BIGINT) AS det FROM r GROUP BY ROLLUP (split)""")
def chain_audit(spark, d):
    """Select by size, keep what becomes empty, and audit by split."""
    s = dataset(spark, d).pipe(lambda x: x.select(min_box_px=80, min_side_px=100, empty="keep"))
    return s.audit().select("split", "images", "annotated", "empty", "det")


@query(f"WITH {V_BOXES}, {V_IMAGES} SELECT i.path, CAST(round(b.x1) AS BIGINT) AS x1, CAST(round(b.y1) AS BIGINT) AS y1, CAST(b.w AS BIGINT) AS w, CAST(b.h AS BIGINT) AS h, label, split FROM v_boxes b JOIN v_images i ON i.image = b.image")
def coco_files(spark, d):
    """All boxes written as documents, found out to be such, and read."""
    root = place(spark, "coco")
    dataset(spark, d).write(root, "coco")
    return _read_back(spark, root)


@query(f"WITH {V_BOXES}, {V_IMAGES} SELECT concat(split, '/', i.path) AS path, CAST(round(b.x1) AS BIGINT) AS x1, CAST(round(b.y1) AS BIGINT) AS y1, CAST(b.w AS BIGINT) AS w, CAST(b.h AS BIGINT) AS h, label, split FROM v_boxes b JOIN v_images i ON i.image = b.image")
def labelme_files(spark, d):
    """All boxes written as shapes, a file for each image, found out to be such, and read."""
    root = place(spark, "labelme")
    dataset(spark, d).write(root, "labelme")
    return _read_back(spark, root)


def _read_back(spark, root: str) -> DataFrame:
    s = router.read_dataset(spark, root)
    px = s.pixels().join(s.records.select("record_id", "path", "split"), "record_id")
    whole = lambda c: F.round(c).cast("long")
    return px.select("path", whole(F.col("x1")).alias("x1"), whole(F.col("y1")).alias("y1"), whole(F.col("x2") - F.col("x1")).alias("w"), whole(F.col("y2") - F.col("y1")).alias("h"), "label", "split")


@query(f"{_qa}, p AS (SELECT conv_id, turn, question, CASE WHEN turn % 4 = 1 THEN '' ELSE answer END AS answer FROM v_qas WHERE trim(question) = question AND question <> '') SELECT concat('c', CAST(conv_id AS VARCHAR)) AS sample_key, question, answer FROM p")
def vqa_files(spark, d):
    """All questions written as manifests, found out to be such, and read."""
    t = _asked(spark, d).select(F.col("conv_id").alias("record_id"), F.concat(F.lit("c"), "conv_id", F.lit(".jpg")).alias("path"), F.lit("train").alias("split"), F.filter("qas", lambda q: (F.trim(q["question"]) == q["question"]) & (q["question"] != "")).alias("qas"))
    root = place(spark, "vqa")
    Dataset(t, folders.no_anns(spark)).write(root, "vqa_style")
    s = router.read_dataset(spark, root)
    return s.records.select("sample_key", F.explode("qas").alias("q")).select("sample_key", "q.question", "q.answer")


@query(f"WITH {V_BOXES}, n AS (SELECT CASE WHEN image % 2 = 0 THEN 0 ELSE 1 END AS src, label, count(*) AS n FROM v_boxes GROUP BY 1, 2) SELECT src, label, CAST(CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS cls, n FROM n")
def sources_united(spark, d):
    """Two datasets whose class lists differ in order, as one."""
    from orrery.dataset import union

    s = dataset(spark, d)
    part = lambda k: s.with_(records=s.records.where(F.col("record_id") % 2 == k), anns=s.anns.where(F.col("record_id") % 2 == k))
    turned = part(1).with_(classes=("R", "N", "A"), anns=part(1).anns.withColumn("cls", 2 - F.col("cls")))
    u = union([part(0), turned])
    return u.anns.join(u.records.select("record_id", "src"), "record_id").groupBy("src", "label", "cls").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM documents")
def stats_pruned(spark, d):
    """What a statistics file keeps of a document: only values."""
    n = table(spark, d, "documents").count()
    kept = configs.pruned({"n": n, "none": None, "empty": {}, "deep": {"x": []}})
    return spark.createDataFrame([(kept["n"],)], "n long") if list(kept) == ["n"] else spark.createDataFrame([(-1,)], "n long")
