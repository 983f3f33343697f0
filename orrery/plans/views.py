"""Deterministic record, box, hash and question views over the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_digit = "substr(sha1(CAST(doc_id AS {s})), 1, 1)"
_split = "CASE WHEN {d} IN ('b', 'c') THEN 'val' WHEN {d} IN ('d', 'e', 'f') THEN 'test' ELSE 'train' END"
_path = "concat(source, '/', lang, '/doc_', CAST(doc_id AS {s}), '.txt')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: path, split, class, size, and labels where there are any."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.expr(_path.format(s="string")).alias("path"),
        F.expr(_split.format(d=_digit.format(s="string"))).alias("split"),
        F.col("lang").alias("class"),
        F.col("source").alias("grp"),
        F.col("n_chars").alias("file_bytes"),
        F.col("text"),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), "quality", "toxic")
    return d.join(labels, "record_id", "left")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on images of 1000 x 1000 pixels."""
    cols = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ann = f"row_number() over (partition by l_partkey order by {', '.join(cols)})"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as image",
        f"cast({ann} as bigint) as ann",
        "cast((l_orderkey * 37) % 800 as double) as x1",
        "cast((l_suppkey * 53) % 800 as double) as y1",
        "20.0D + 4 * l_quantity as w",
        "cast(20 + (l_orderkey % 50) * 4 as double) as h",
        "1 - l_discount as score",
        "l_returnflag as label",
        "case when l_linestatus = 'O' then 'det' else 'seg' end as kind",
    )


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of the embeddings as packed 64-bit hashes."""
    bits = "aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", f"{bits} as h", "if(vec_id % 5 = 0, 'test', 'train') as split")


def qas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's turn that follows."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


V_RECORDS = f"""v_records AS (
  SELECT d.doc_id AS record_id, {_path.format(s='VARCHAR').replace('doc_id', 'd.doc_id')} AS path,
         {_split.format(d=_digit.format(s='VARCHAR').replace('doc_id', 'd.doc_id'))} AS split,
         lang AS class, source AS grp, n_chars AS file_bytes, text, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
V_BOXES = """v_boxes AS (
  SELECT l_partkey AS image, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ann,
         CAST((l_orderkey * 37) % 800 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 800 AS DOUBLE) AS y1,
         20 + 4 * l_quantity AS w, CAST(20 + (l_orderkey % 50) * 4 AS DOUBLE) AS h, 1 - l_discount AS score, l_returnflag AS label,
         CASE WHEN l_linestatus = 'O' THEN 'det' ELSE 'seg' END AS kind
  FROM lineitem)"""
V_HASH = """v_hash AS (
  SELECT vec_id, label, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(CASE WHEN i = 64 THEN -9223372036854775808 ELSE (1::BIGINT << (i - 1)::BIGINT) END AS HUGEINT) ELSE 0 END)), lambda a, b: a + b) AS BIGINT) AS h,
         CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM embeddings)"""
V_QAS = """v_qas AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user')"""
