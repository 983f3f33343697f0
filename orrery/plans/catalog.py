"""The registered queries over the test tables, with the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import keys
from orrery.operators import annotations as ann
from orrery.operators import answers, arrange, geometry, matching, profile, sampling, similarity, splitting, statistics
from orrery.operators.graph import connected_components
from orrery.plans.views import V_BOXES, V_HASH, V_QAS, V_RECORDS, boxes, hashes, qas, records, table
from orrery.sources import coco, files, yolo
from orrery.streaming import dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLITS = ["train", "val", "test"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


LAYOUT = r"regexp_replace(path, '^(?:(?:train|val|valid|validation|test|eval|images)/)+', '')"


@query(f"WITH {V_RECORDS}, p AS (SELECT record_id, concat(split, '/images/', path) AS path FROM v_records) SELECT record_id, {LAYOUT} AS layout FROM p")
def layout_path(spark, d):
    return records(spark, d).select("record_id", keys.layout_path(F.concat_ws("/", "split", F.lit("images"), "path")).alias("layout"))


@query(f"WITH {V_RECORDS} SELECT record_id, split_part(path, '/', 1) AS dir0, split_part(path, '/', 2) AS dir_last FROM v_records")
def key_dir(spark, d):
    p = F.col("path")
    return records(spark, d).select("record_id", keys.dir_key(p, 0).alias("dir0"), keys.dir_key(p, -1).alias("dir_last"))


@query(f"WITH {V_RECORDS} SELECT record_id, CASE WHEN regexp_matches(path, 'doc_([0-9])5') THEN regexp_extract(path, 'doc_([0-9])5', 1) END AS key FROM v_records")
def key_regex(spark, d):
    return records(spark, d).select("record_id", keys.regex_key(F.col("path"), "doc_([0-9])5").alias("key"))


@query(f"WITH {V_RECORDS}, k AS (SELECT DISTINCT path AS name, concat('q', CAST(quality AS VARCHAR)) AS v FROM v_records WHERE quality IS NOT NULL) SELECT record_id, k.v AS key FROM v_records LEFT JOIN k ON path = name")
def key_file(spark, d):
    r = records(spark, d)
    table_ = r.where("quality is not null").select(F.col("path").alias("name"), F.concat(F.lit("q"), F.col("quality")).alias("v")).distinct()
    return keys.file_key(r.select("record_id", "path"), table_).select("record_id", "key")


@query(f"WITH {V_RECORDS}, p AS (SELECT record_id, concat('doc_', CAST(record_id % 700 AS VARCHAR)) AS k, path FROM v_records) SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN concat(k, '|', path) ELSE k END AS key FROM p")
def record_keys_dedup(spark, d):
    r = records(spark, d).select("record_id", F.concat(F.lit("doc_"), F.col("record_id") % 700).alias("short"), "path")
    return keys.record_keys(r, "short", "path").select("record_id", "key")


@query(f"WITH {V_RECORDS} SELECT record_id FROM v_records ORDER BY sha1(concat('0:', CAST(record_id AS VARCHAR))), record_id LIMIT 25")
def nested_sample_25(spark, d):
    return sampling.take(records(spark, d), "record_id", 25).select("record_id")


@query(f"WITH {V_RECORDS} SELECT record_id, split, class FROM v_records QUALIFY row_number() OVER (PARTITION BY split, class ORDER BY sha1(concat('7:', CAST(record_id AS VARCHAR))), CAST(record_id AS VARCHAR)) <= 10")
def stratified_sample(spark, d):
    return sampling.take(records(spark, d), "record_id", 10, seed=7, by=["split", "class"]).select("record_id", "split", "class")


@query(f"WITH {V_RECORDS}, n AS (SELECT class, greatest(1, floor(count(*) * 0.1)) AS k FROM v_records GROUP BY class) SELECT record_id, class FROM v_records JOIN n USING (class) QUALIFY row_number() OVER (PARTITION BY class ORDER BY sha1(concat('0:', CAST(record_id AS VARCHAR))), CAST(record_id AS VARCHAR)) <= k")
def share_sample(spark, d):
    return sampling.take_share(records(spark, d), "record_id", 0.1, by=["class"]).select("record_id", "class")


_sized = f"WITH {V_RECORDS}, s AS (SELECT class, count(*) AS n FROM v_records GROUP BY class), t AS (SELECT class, {{}} AS k FROM s) SELECT record_id, class FROM v_records JOIN t USING (class) QUALIFY row_number() OVER (PARTITION BY class ORDER BY sha1(concat('0:', CAST(record_id AS VARCHAR))), CAST(record_id AS VARCHAR)) <= k"


@query(_sized.format("least(n, greatest(1, floor(n * 50 / (SELECT max(n) FROM s))))"))
def class_sample_preserve(spark, d):
    return sampling.class_sample(records(spark, d), "record_id", "class", "preserve", max_n=50).select("record_id", "class")


@query(_sized.format("least(n, greatest(1, floor((SELECT min(n) FROM s) * 0.5)))"))
def class_sample_balance(spark, d):
    return sampling.class_sample(records(spark, d), "record_id", "class", "balance", max_frac=0.5).select("record_id", "class")


@query(f"WITH {V_RECORDS} SELECT record_id, split FROM v_records QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha1(concat('0:', CAST(record_id AS VARCHAR))), CAST(record_id AS VARCHAR)) <= 100")
def max_images_cap(spark, d):
    return sampling.take(records(spark, d), "record_id", 100, by=["split"]).select("record_id", "split")


_rule = "CASE WHEN sqrt(w * h) < 80 THEN 'min_box' WHEN greatest(w, h) < 100 THEN 'min_side' WHEN w * h / 1000000.0 < 0.009 THEN 'min_area_frac' END"


def _ruled(spark, d):
    b = boxes(spark, d)
    return b.withColumn("rule", ann.size_rule(F.col("w"), F.col("h"), F.lit(1e6), 80, 100, 0.009))


@query(f"WITH {V_BOXES} SELECT image, ann, label FROM v_boxes WHERE {_rule} IS NULL")
def select_min_box(spark, d):
    return _ruled(spark, d).where("rule is null").select("image", F.col("ann").cast("long").alias("ann"), "label")


@query(f"WITH {V_BOXES} SELECT {_rule} AS rule, count(*) AS n FROM v_boxes WHERE {_rule} IS NOT NULL GROUP BY 1")
def select_rule_counts(spark, d):
    return _ruled(spark, d).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {V_RECORDS} SELECT record_id, class FROM v_records WHERE class IN ('de', 'en')")
def select_keep_class(spark, d):
    return records(spark, d).where(F.col("class").isin("de", "en")).select("record_id", "class")


@query(f"WITH {V_RECORDS} SELECT record_id, path FROM v_records WHERE NOT regexp_matches(path, '^src1[0-9]*/|_[0-9]*7\\.txt$')")
def exclude_name(spark, d):
    return records(spark, d).where(~F.col("path").rlike(r"^src1[0-9]*/|_[0-9]*7\.txt$")).select("record_id", "path")


@query(f"WITH {V_BOXES} SELECT CASE label WHEN 'A' THEN 'kept' WHEN 'N' THEN 'kept' ELSE 'rest' END AS label, count(*) AS n FROM v_boxes WHERE label <> 'R' OR kind = 'det' GROUP BY 1")
def remap_classes(spark, d):
    b = ann.remap(boxes(spark, d).where("label <> 'R' or kind = 'det'"), "label", {"A": "kept", "N": "kept"}, others="rest")
    return b.groupBy("label").agg(F.count("*").alias("n"))


_probs = "[{'label': 'a', 'score': (doc_id * 7 % 100) / 100.0}, {'label': 'b', 'score': (doc_id * 13 % 100) / 100.0}, {'label': 'c', 'score': (doc_id * 29 % 100) / 100.0}]"


def _scored(spark, d):
    p = lambda k, m: F.struct(F.lit(k).alias("label"), (F.col("doc_id") * m % 100 / 100.0).alias("score"))
    return table(spark, d, "documents").select("doc_id", F.array(p("a", 7), p("b", 13), p("c", 29)).alias("probs"))


@query("WITH p AS (SELECT doc_id, (doc_id * 7 % 100) / 100.0 AS a, (doc_id * 13 % 100) / 100.0 AS b, (doc_id * 29 % 100) / 100.0 AS c FROM documents) SELECT doc_id, CASE WHEN a >= 0.9 OR b >= 0.8 OR c >= 0.8 THEN CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END ELSE 'unlabeled' END AS label FROM p")
def class_route_single(spark, d):
    return _scored(spark, d).select("doc_id", answers.route(F.col("probs"), 0.8, {"a": 0.9}).alias("label"))


@query("WITH p AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS label, unnest([doc_id * 7 % 100, doc_id * 13 % 100, doc_id * 29 % 100]) AS s FROM documents), h AS (SELECT doc_id, label FROM p WHERE s / 100.0 >= 0.8) SELECT d.doc_id, coalesce(h.label, 'unlabeled') AS label FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id")
def class_route_multi(spark, d):
    return _scored(spark, d).select("doc_id", F.explode(answers.route_all(F.col("probs"), 0.8)).alias("label"))


@query(f"WITH {V_RECORDS} SELECT class, count(*) AS instances, count(DISTINCT record_id) AS images, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM v_records GROUP BY class")
def structure(spark, d):
    return profile.class_table(records(spark, d), "class", "split", "record_id", SPLITS)


@query(f"WITH {V_BOXES}, s AS (SELECT label, w * h AS v FROM v_boxes) SELECT label, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {q}), 2) AS p{int(q * 100)}" for q in profile.QUANTILES) + " FROM s GROUP BY label")
def box_size_quantiles(spark, d):
    return profile.size_quantiles(boxes(spark, d), "label", F.col("w") * F.col("h"))


@query(f"WITH {V_BOXES}, g AS (SELECT image, count(*) AS size FROM v_boxes GROUP BY image) SELECT size, count(*) AS n FROM g GROUP BY size")
def instances_hist(spark, d):
    return profile.histogram(boxes(spark, d), "image")


@query(f"WITH {V_BOXES} SELECT CAST(least(greatest(floor((x1 + w / 2) / 1000 * 40), 0), 39) AS INTEGER) AS cx, CAST(least(greatest(floor((y1 + h / 2) / 1000 * 40), 0), 39) AS INTEGER) AS cy, count(*) AS n FROM v_boxes GROUP BY 1, 2")
def center_heatmap(spark, d):
    return profile.heatmap(boxes(spark, d), (F.col("x1") + F.col("w") / 2) / 1000, (F.col("y1") + F.col("h") / 2) / 1000)


@query(f"WITH {V_RECORDS}, n AS (SELECT grp, count(*) AS n FROM v_records GROUP BY grp) SELECT grp, n, CAST(row_number() OVER (ORDER BY n DESC, grp) AS INTEGER) AS rank FROM n")
def long_tail(spark, d):
    return profile.long_tail(records(spark, d), "grp")


@query(f"WITH {V_RECORDS}, n AS (SELECT grp, count(*) AS n FROM v_records GROUP BY grp), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS r FROM n) SELECT grp AS value, n FROM r WHERE r <= 5 UNION ALL SELECT concat('other (', CAST(count(*) AS VARCHAR), ')'), CAST(sum(n) AS BIGINT) FROM r WHERE r > 5 HAVING count(*) > 0")
def top_other(spark, d):
    return profile.top_and_other(records(spark, d), "grp", 5)


@query(f"WITH {V_BOXES} SELECT image, ann FROM v_boxes WHERE x1 < -1 OR y1 < -1 OR x1 + w > 951 OR y1 + h > 951")
def health_outside(spark, d):
    return profile.outside(boxes(spark, d), 950, 950).select("image", F.col("ann").cast("long").alias("ann"))


def _edges(b):
    return b.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))


_iou = "greatest(0, least(a.x1 + a.w, b.x1 + b.w) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.h, b.y1 + b.h) - greatest(a.y1, b.y1))"


@query(f"WITH {V_BOXES}, m AS MATERIALIZED (SELECT image, label, ann, x1, y1, w, h FROM v_boxes), p AS (SELECT a.image, a.label, a.ann AS ann_a, b.ann AS ann_b, {_iou} AS i, a.w * a.h + b.w * b.h AS s FROM m a JOIN m b ON a.image = b.image AND a.label = b.label WHERE a.ann < b.ann) SELECT image, label, ann_a, ann_b FROM p WHERE i / (s - i) >= 0.5")
def health_duplicate_boxes(spark, d):
    return ann.duplicate_boxes(_edges(boxes(spark, d)), "image", "label", "ann", 0.5)


@query(f"WITH {V_RECORDS}, p AS (SELECT concat(grp, '/', class) AS folder, concat('doc_', CAST(record_id % 400 AS VARCHAR)) AS name FROM v_records) SELECT name, count(DISTINCT folder) AS folders FROM p GROUP BY name HAVING count(DISTINCT folder) > 1")
def health_shared_names(spark, d):
    return profile.shared_names(records(spark, d).select(F.concat_ws("/", "grp", "class", F.concat(F.lit("doc_"), F.col("record_id") % 400)).alias("path")), "path")


@query(f"WITH {V_RECORDS} SELECT record_id, min(record_id) OVER (PARTITION BY text) AS first, CAST(strlen(text) AS INTEGER) AS size FROM v_records QUALIFY record_id <> min(record_id) OVER (PARTITION BY text)")
def health_exact_duplicates(spark, d):
    return profile.exact_duplicates(records(spark, d), "record_id", "text")


@query(f"WITH {V_RECORDS} SELECT min(record_id) AS record_id FROM v_records GROUP BY text")
def exact_dedup_keep_first(spark, d):
    r = records(spark, d).select("record_id", "text")
    return r.join(profile.exact_duplicates(r, "record_id", "text").select("record_id"), "record_id", "left_anti").select("record_id")


@query(f"WITH {V_RECORDS} SELECT record_id FROM v_records WHERE record_id % 2 = 1 AND text NOT IN (SELECT text FROM v_records WHERE record_id % 2 = 0)")
def dedup_against_existing(spark, d):
    r = records(spark, d).withColumn("size", F.octet_length("text")).withColumn("sha1", F.sha1(F.col("text").cast("binary")))
    return r.where("record_id % 2 = 1").join(r.where("record_id % 2 = 0").select("size", "sha1"), ["size", "sha1"], "left_anti").select("record_id")


@query(f"""WITH {V_RECORDS}, n AS (SELECT class, split, count(*) AS n FROM v_records GROUP BY class, split),
  c AS (SELECT class, sum(n) AS c FROM n GROUP BY class), s AS (SELECT split, sum(n) AS s FROM n GROUP BY split)
  SELECT class, split, n, round(n / c, 6) AS class_share, round(s / (SELECT sum(n) FROM n), 6) AS split_share, round(n / c - s / (SELECT sum(n) FROM n), 6) AS deviation FROM n JOIN c USING (class) JOIN s USING (split)""")
def class_balance(spark, d):
    return profile.class_balance(records(spark, d), "class", "split")


@query(f"""WITH {V_RECORDS}, u AS (SELECT DISTINCT grp FROM v_records), s AS (SELECT DISTINCT split FROM v_records WHERE split <> 'train'),
  n AS (SELECT u.grp, s.split, count(v.record_id) AS n FROM u CROSS JOIN s LEFT JOIN v_records v ON v.grp = u.grp AND v.split = s.split GROUP BY 1, 2)
  SELECT split, count(*) FILTER (n = 0) AS none, count(*) FILTER (n < 5) AS under_5, count(*) FILTER (n < 20) AS under_20 FROM n GROUP BY split""")
def missing_classes(spark, d):
    return profile.missing_classes(records(spark, d), "grp", "split")


@query(f"""WITH {V_RECORDS}, n AS (SELECT text, split, count(*) AS n FROM v_records GROUP BY text, split)
  SELECT a.split AS split_a, b.split AS split_b, count(*) AS groups, CAST(sum(a.n + b.n) AS BIGINT) AS rows FROM n a JOIN n b ON a.text = b.text AND a.split < b.split GROUP BY 1, 2""")
def straddle_pairs(spark, d):
    return profile.straddling(records(spark, d).withColumn("g", F.sha2("text", 256)), "g", "split")


@query(f"WITH {V_HASH}, c AS (SELECT h, min(vec_id) AS id, count(*) AS n FROM v_hash GROUP BY h) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 20")
def hamming_pairs(spark, d):
    return similarity.pairs_within(hashes(spark, d), "vec_id", "h", 20)


@query(f"WITH {V_HASH}, c AS (SELECT h, min(vec_id) AS id, count(*) AS n FROM v_hash GROUP BY h) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 9")
def hamming_pairs_banded(spark, d):
    """Few bits, by bands."""
    return similarity.pairs_within(hashes(spark, d), "vec_id", "h", 9)


@query(f"WITH {V_HASH} SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY h) AS a FROM v_hash")
def hamming_members(spark, d):
    return similarity.members(hashes(spark, d), "vec_id", "h")


@query(f"WITH {V_HASH} SELECT q.vec_id AS q, r.vec_id AS r, CAST(bit_count(xor(q.h, r.h)) AS INTEGER) AS dist, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.h, r.h)), r.vec_id) AS INTEGER) AS rank FROM v_hash q CROSS JOIN v_hash r WHERE q.split = 'test' AND r.split = 'train' QUALIFY rank <= 3")
def hamming_nearest(spark, d):
    h = hashes(spark, d)
    return similarity.nearest(h.where("split = 'test'"), h.where("split = 'train'"), "vec_id", "h", 3)


@query(f"WITH {V_HASH}, b AS (SELECT q.vec_id, min(bit_count(xor(q.h, r.h))) AS dist FROM v_hash q CROSS JOIN v_hash r WHERE q.split = 'test' AND r.split = 'train' GROUP BY 1) SELECT round(avg(CAST(dist <= 20 AS INTEGER)), 6) AS twin_share, count(*) AS n FROM b")
def twin_share(spark, d):
    h = hashes(spark, d)
    near = similarity.nearest(h.where("split = 'test'"), h.where("split = 'train'"), "vec_id", "h", 1)
    return near.agg(F.round(F.avg((F.col("dist") <= 20).cast("int")), 6).alias("twin_share"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {V_HASH}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v_hash a JOIN v_hash b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 18),
  w AS (SELECT vec_id AS id, vec_id AS component FROM v_hash UNION SELECT e.b, w.component FROM w JOIN e ON e.a = w.id)
  SELECT id, min(component) AS component FROM w GROUP BY id""")
def group_components(spark, d):
    return similarity.similarity_components(hashes(spark, d), "vec_id", "h", 18)


@query(f"""WITH RECURSIVE {V_HASH}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v_hash a JOIN v_hash b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 18),
  w AS (SELECT vec_id AS id, vec_id AS component FROM v_hash UNION SELECT e.b, w.component FROM w JOIN e ON e.a = w.id),
  c AS (SELECT id, min(component) AS component FROM w GROUP BY id)
  SELECT split, label, count(*) AS rows, count(DISTINCT component) AS units, round(1.96 * sqrt(0.25 / count(DISTINCT component)), 6) AS half_width
  FROM v_hash JOIN c ON vec_id = id WHERE split <> 'train' GROUP BY 1, 2""")
def independent_units(spark, d):
    h = hashes(spark, d)
    c = similarity.similarity_components(h, "vec_id", "h", 18)
    return profile.units(h.join(c, h.vec_id == c.id), "component", "split", "label")


@query(f"WITH {V_HASH}, s AS (SELECT list_transform(list({{'i': vec_id, 'h': h}} ORDER BY vec_id), lambda x: [x]) AS l FROM v_hash), k AS (SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: bit_count(xor(x.h, b[1].h)) <= 20)) = 0 THEN list_concat(a, b) ELSE a END)) AS x FROM s) SELECT x.i AS vec_id FROM k")
def perceptual_dedup_sequential(spark, d):
    return similarity.sequential_dedup(hashes(spark, d), "vec_id", "h", 20).select("vec_id")


@query(f"""WITH {V_BOXES}, s AS (SELECT *, CASE WHEN image % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM v_boxes)
  SELECT split, count(DISTINCT image) AS images, count(*) AS annotations, count(*) FILTER (kind = 'det') AS det, count(*) FILTER (kind = 'seg') AS seg,
  round(min(score), 6) AS min_score, round(avg(score), 4) AS mean_score, round(max(score), 6) AS max_score FROM s GROUP BY ROLLUP (split)""")
def audit_rollup(spark, d):
    b = boxes(spark, d).withColumn("split", F.when(F.col("image") % 5 == 0, "val").otherwise("train"))
    return profile.audit(b, "split", "image")


@query(f"WITH {V_QAS} SELECT conv_id, turn, length(question) AS n_question, length(answer) AS n_answer FROM v_qas")
def vqa_pairs(spark, d):
    return qas(spark, d).select("conv_id", "turn", F.char_length("question").cast("long").alias("n_question"), F.char_length("answer").cast("long").alias("n_answer"))


_bins = "CAST((file_bytes > q[1])::INT + (q[2] > q[1] AND file_bytes > q[2])::INT + (q[3] > q[2] AND file_bytes > q[3])::INT AS INTEGER)"
_q = f"{V_RECORDS}, q AS (SELECT quantile_cont(file_bytes, [0.25, 0.5, 0.75]) AS q FROM v_records WHERE split = 'train'), b AS (SELECT record_id, class, split, {_bins} AS bin FROM v_records, q)"


@query(f"WITH {_q} SELECT bin, class, count(*) AS n FROM b WHERE split = 'train' GROUP BY bin, class")
def cue_bins(spark, d):
    b = profile.quartile_bins(records(spark, d), "file_bytes", F.col("split") == "train")
    return b.where("split = 'train'").groupBy("bin", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {_q}, s AS (SELECT class, count(*) AS n FROM b WHERE split = 'train' GROUP BY class),
  r AS (SELECT bin, b.class, count(*) / any_value(s.n) AS share FROM b JOIN s ON b.class = s.class WHERE split = 'train' GROUP BY bin, b.class),
  m AS (SELECT bin, arg_min(class, (-share, class)) AS named FROM r GROUP BY bin),
  u AS (SELECT arg_min(class, (-n, class)) AS usual FROM s),
  p AS (SELECT b.class, avg(CAST(coalesce(named, usual) = b.class AS INTEGER)) AS recall FROM b LEFT JOIN m USING (bin) CROSS JOIN u WHERE split <> 'train' GROUP BY b.class)
  SELECT round(avg(recall), 6) AS balanced FROM p""")
def leak_accuracy(spark, d):
    b = profile.quartile_bins(records(spark, d), "file_bytes", F.col("split") == "train")
    return profile.likelihood_rule(b, "bin", "class", F.col("split") == "train")


@query(f"WITH {V_BOXES} SELECT image, ann, label FROM v_boxes QUALIFY row_number() OVER (PARTITION BY image, label ORDER BY score DESC, ann) <= 3")
def topk_per_class(spark, d):
    return ann.top_k(boxes(spark, d), ["image", "label"], 3).select("image", F.col("ann").cast("long").alias("ann"), "label")


_pixels = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + 1) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + 1)"


def _suppressed(name: str, of: str, by: str, limit: float, other: str = "") -> str:
    """Boxes by falling score that no kept one overlaps beyond ``limit``, as a fold over each group's list; areas count edge pixels."""
    over = _pixels.format(a="k", b="b[1]")
    area = "({0}.x2 - {0}.x1 + 1) * ({0}.y2 - {0}.y1 + 1)"
    hit = f"{over} > {limit} * ({area.format('k')} + {area.format('b[1]')} - {over} + 1e-9){other}"
    return f"""{name}_l AS (SELECT {by}, list_transform(list({{'image': image, 'ann': ann, 'label': label, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, ann), lambda x: [x]) AS l FROM {of} GROUP BY {by}),
  {name} AS (SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda k: {hit})) = 0 THEN list_concat(a, b) ELSE a END), recursive := true) FROM {name}_l)"""


_boxed = f"{V_BOXES}, e AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM v_boxes)"


@query(f"WITH {_boxed}, {_suppressed('n', 'e', 'image, label', 0.3)} SELECT image, ann, label FROM n")
def nms_per_class(spark, d):
    return ann.nms(_edges(boxes(spark, d)), ["image", "label"], 0.3).select("image", "ann", "label")


_other = " AND k.label <> b[1].label"


@query(f"WITH {_boxed}, {_suppressed('n', 'e', 'image, label', 0.3)}, t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY image, label ORDER BY score DESC, ann) <= 5), {_suppressed('c', 't', 'image', 0.6, _other)} SELECT image, ann, label FROM c")
def filter_postprocess(spark, d):
    return ann.postprocess(_edges(boxes(spark, d)), nms_limit=0.3, k=5, cross_limit=0.6).select("image", "ann", "label")


@query(f"""WITH {V_BOXES}, pairs AS (SELECT p.image, p.label, p.ann AS p, t.ann AS t, {_iou.replace("a.", "p.").replace("b.", "t.")} / (p.w * p.h + t.w * t.h - {_iou.replace("a.", "p.").replace("b.", "t.")}) AS iou FROM v_boxes p JOIN v_boxes t ON p.image = t.image AND p.label = t.label AND p.kind = 'det' AND t.kind = 'seg'),
  g AS (SELECT image, label, list_transform(list({{'p': p, 't': t}} ORDER BY iou DESC, p, t), lambda x: [x]) AS l FROM pairs WHERE iou >= 0.3 GROUP BY image, label),
  k AS (SELECT image, label, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.p = b[1].p OR x.t = b[1].t)) = 0 THEN list_concat(a, b) ELSE a END)) AS m FROM g)
  SELECT v.label, count(m) AS tp, count(*) - count(m) AS fp FROM v_boxes v LEFT JOIN k ON k.image = v.image AND k.label = v.label AND k.m.p = v.ann WHERE v.kind = 'det' GROUP BY v.label""")
def match_tp_fp(spark, d):
    b = _edges(boxes(spark, d))
    out = matching.matched(b.where("kind = 'det'"), b.where("kind = 'seg'"), ["image", "label"], 0.3)
    return out.groupBy("label").agg(F.count(F.when(F.col("tp"), 1)).alias("tp"), F.count(F.when(~F.col("tp"), 1)).alias("fp"))


@query(f"""WITH {V_BOXES}, t AS (SELECT *, (image + ann) % 3 = 0 AS tp FROM v_boxes),
  r AS (SELECT *, sum(CAST(tp AS INTEGER)) OVER w AS hits, count(*) OVER w AS k FROM t WINDOW w AS (PARTITION BY label ORDER BY score DESC, image, ann ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, max(hits / k) OVER (PARTITION BY label ORDER BY score DESC, image, ann ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM r)
  SELECT label, round(sum(best) FILTER (tp) / 1000000, 9) AS ap FROM e GROUP BY label""")
def ap_curve(spark, d):
    t = boxes(spark, d).withColumn("tp", (F.col("image") + F.col("ann")) % 3 == 0)
    return ann.average_precision(t, "label", 1_000_000, ["image", "ann"]).select("label", F.round("ap", 9).alias("ap"))


@query()
def split_ratio(spark, d):
    r = records(spark, d).drop("split")
    return splitting.split(r, "grp", "class", {"train": 0.7, "val": 0.15, "test": 0.15}).select("record_id", "grp", "split")


@query()
def split_kfold(spark, d):
    return splitting.folds(records(spark, d), "grp", "class", 5).select("record_id", "grp", "fold")


@query()
def split_pinned(spark, d):
    r = records(spark, d).withColumn("pin", F.when(F.col("grp") == "src3", "test"))
    return splitting.split(r.drop("split"), "grp", "class", {"train": 0.8, "val": 0.1, "test": 0.1}, pinned="pin").select("record_id", "grp", "split")


_answer = "CASE record_id % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'The answer is no' WHEN 2 THEN 'Final answer: YES because it is' WHEN 3 THEN 'maybe' ELSE '' END"


@query(f"WITH {V_RECORDS} SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'unclear' END AS label, CASE record_id % 5 WHEN 0 THEN 'full_answer' WHEN 1 THEN 'leadin_span' WHEN 2 THEN 'trimmed_span' WHEN 3 THEN 'no_match' ELSE 'empty' END AS rule FROM v_records")
def map_answers(spark, d):
    r = records(spark, d).select("record_id", F.expr(_answer).alias("answer"))
    return answers.map_answers(r, "answer", {"yes": "yes", "no": "no"}).select("record_id", "label", "rule")


@query("SELECT doc_id, lpad(CAST(row_number() OVER (ORDER BY source, doc_id) + 100 AS VARCHAR), 6, '0') AS name FROM documents")
def rename_seq(spark, d):
    t = arrange.with_rank(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "n")
    return t.select("doc_id", F.lpad((F.col("n") + 101).cast("string"), 6, "0").alias("name"))


@query("WITH p AS (SELECT unnest(['a cat', 'a dog']) AS prompt), s AS (SELECT unnest(range(1, 4)) AS i) SELECT doc_id, prompt, concat('doc_', CAST(doc_id AS VARCHAR), '_', lpad(CAST(i AS VARCHAR), 4, '0')) AS key FROM documents CROSS JOIN p CROSS JOIN s")
def prompt_fanout(spark, d):
    e = F.array(F.lit("a cat"), F.lit("a dog"))
    t = table(spark, d, "documents").select("doc_id", F.explode(e).alias("prompt"))
    t = t.select("doc_id", "prompt", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    return t.select("doc_id", "prompt", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("_"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("key"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_a' WHEN a.doc_id IS NULL THEN 'only_b' ELSE 'changed' END AS what FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 4) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang <> b.lang")
def dataset_diff(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    a = t.where("doc_id % 10 <> 3").select("doc_id", F.col("lang").alias("a"))
    b = t.where("doc_id % 10 <> 4").select("doc_id", F.expr("if(doc_id % 10 = 5, upper(lang), lang)").alias("b"))
    j = a.join(b, "doc_id", "full").where("a is null or b is null or a <> b")
    return j.select("doc_id", F.expr("case when b is null then 'only_a' when a is null then 'only_b' else 'changed' end").alias("what"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 10 <> 0)")
def coco_fk_check(spark, d):
    parts = table(spark, d, "part").where("p_partkey % 10 <> 0")
    return coco.orphans(table(spark, d, "lineitem"), parts, {"l_partkey": "p_partkey"}).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {V_QAS}, k AS (SELECT conv_id * 1000 + turn AS k, question, answer FROM v_qas) SELECT q.k, q.question, a.answer, p.answer AS predicted FROM k q LEFT JOIN (SELECT * FROM k WHERE k % 3 <> 0) a ON a.k = q.k LEFT JOIN (SELECT * FROM k WHERE k % 2 = 0) p ON p.k = q.k")
def vqa_three_way_join(spark, d):
    k = qas(spark, d).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    predicted = k.where("k % 2 = 0").select("k", F.col("answer").alias("predicted"))
    return files.vqa_items(k.select("k", "question"), k.where("k % 3 <> 0").select("k", "answer"), predicted, "k")


@query("""WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS src FROM documents),
  f AS (SELECT lang, min(src * 1000000000000 + doc_id) AS met FROM r WHERE lang IS NOT NULL GROUP BY lang),
  v AS (SELECT lang, row_number() OVER (ORDER BY met) - 1 AS cls FROM f)
  SELECT doc_id, r.lang, src, cls FROM r LEFT JOIN v ON r.lang = v.lang""")
def multi_source_union(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    return files.union_sources([t.where("doc_id % 2 = 1"), t.where("doc_id % 2 = 0")], "lang", "doc_id")[0].select("doc_id", "lang", "src", "cls")


@query(f"WITH {V_BOXES} SELECT CAST(image AS VARCHAR) AS image, row_number() OVER (PARTITION BY image ORDER BY ann) AS ann, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM v_boxes")
def yolo_round_trip(spark, d):
    """Boxes written as label lines and read from them again."""
    share = lambda c: F.col(c) / 1000
    rows = boxes(spark, d).select(
        F.col("image").cast("string").alias("path"), "ann", F.lit("det").alias("kind"), F.expr("case label when 'A' then 0 when 'N' then 1 else 2 end").alias("cls"),
        (share("x1") + share("w") / 2).alias("cx"), (share("y1") + share("h") / 2).alias("cy"), share("w").alias("w"), share("h").alias("h"), F.array().cast("array<double>").alias("points"),
    )
    back = yolo.annotations(yolo.parsed(yolo.to_lines(rows)), "det")
    px = lambda c: F.round(c * 1000).cast("long")
    return back.select(F.col("path").alias("image"), "ann", "cls", px(F.col("cx") - F.col("w") / 2).alias("x1"), px(F.col("cy") - F.col("h") / 2).alias("y1"), px(F.col("w")).alias("w"), px(F.col("h")).alias("h"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars AS b, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  w AS (SELECT doc_id, b, r, CAST(0 AS INTEGER) AS shard, CAST(1 AS BIGINT) AS n, b AS total FROM o WHERE r = 1 UNION ALL
  SELECT o.doc_id, o.b, o.r, CAST(CASE WHEN w.n >= 100 OR w.total + o.b > 300000 THEN w.shard + 1 ELSE w.shard END AS INTEGER), CASE WHEN w.n >= 100 OR w.total + o.b > 300000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 100 OR w.total + o.b > 300000 THEN o.b ELSE w.total + o.b END
  FROM w JOIN o ON o.r = w.r + 1) SELECT doc_id, b AS n_chars, shard FROM w""")
def shard_plan(spark, d):
    return files.shard_plan(table(spark, d, "documents"), "doc_id", "n_chars", 100, 300_000)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, d):
    return dedup.counts(table(spark, d, "events"), "ts", "1 day", ["event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_incremental_dedup(spark, d):
    return dedup.first_by_key(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").drop("ts")


@query(f"""WITH {V_BOXES}, c AS (SELECT image, ann, CAST(greatest(0, floor(x1 - 0.25 * w)) AS BIGINT) AS l, CAST(greatest(0, floor(y1 - 0.25 * h)) AS BIGINT) AS t,
  CAST(least(800, ceil(x1 + w + 0.25 * w)) AS BIGINT) AS r, CAST(least(800, ceil(y1 + h + 0.25 * h)) AS BIGINT) AS b FROM v_boxes)
  SELECT image, ann, l AS "left", t AS top, r AS "right", b AS bottom FROM c WHERE r > l AND b > t""")
def crop_rects(spark, d):
    c = boxes(spark, d).select("image", "ann", geometry.crop(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), F.lit(800), F.lit(800), 0.25).alias("c"))
    return c.where("c is not null").select("image", "ann", "c.*")


@query(f"""WITH {V_BOXES}, s AS (SELECT image, ann, w, h, least(224.0 / w, 160.0 / h) AS f FROM v_boxes),
  n AS (SELECT image, ann, CAST(greatest(1, round_even(w * f, 0)) AS BIGINT) AS nw, CAST(greatest(1, round_even(h * f, 0)) AS BIGINT) AS nh FROM s)
  SELECT image, ann, nw AS w, nh AS h, CAST(floor((224 - nw) / 2) AS BIGINT) AS pad_x, CAST(floor((160 - nh) / 2) AS BIGINT) AS pad_y FROM n""")
def letterbox_math(spark, d):
    return boxes(spark, d).select("image", "ann", geometry.letterbox(F.col("w"), F.col("h"), 224, 160).alias("c")).select("image", "ann", "c.w", "c.h", "c.pad_x", "c.pad_y")


@query(f"WITH {V_BOXES} SELECT label, count(*) AS n, CAST(sum(CASE kind WHEN 'det' THEN 1 ELSE 0 END) AS BIGINT) AS det, CAST(sum(CASE kind WHEN 'seg' THEN 1 ELSE 0 END) AS BIGINT) AS seg, CAST(0 AS BIGINT) AS pose, round(min(score), 6) AS score_min, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max FROM v_boxes GROUP BY label")
def label_stats(spark, d):
    return statistics.label_stats(boxes(spark, d))


@query("SELECT count(*) AS images, count(k) AS annotated, count(*) - count(k) AS empty FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) ON k = p_partkey")
def image_stats(spark, d):
    busy = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return statistics.image_stats(table(spark, d, "part"), busy, "p_partkey")


@query("""WITH r AS (SELECT CASE WHEN quality = 1 THEN 1 ELSE 0 END AS q, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS t FROM labels),
  c AS (SELECT 'good' AS class, q + t AS k FROM r WHERE q = 1 UNION ALL SELECT 'toxic', q + t FROM r WHERE t = 1 UNION ALL SELECT 'unlabeled', 0 FROM r WHERE q + t = 0)
  SELECT class, count(*) AS n, count(*) FILTER (WHERE k > 1) AS multi FROM c GROUP BY class""")
def classify_stats(spark, d):
    c = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return statistics.class_stats(table(spark, d, "labels").select(c.alias("classes")), "classes")


@query(f"WITH {V_QAS} SELECT turn, count(*) AS questions, count(*) FILTER (WHERE trim(answer) <> '') AS answered, count(DISTINCT conv_id) AS conv_ids FROM v_qas GROUP BY turn")
def vlm_stats(spark, d):
    return statistics.question_stats(qas(spark, d), "answer", "turn", "conv_id")


FLAGSHIP = structure
