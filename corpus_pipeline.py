"""A corpus pipeline: language, near-duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows and reads them as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, language_id, near_dedup, packing, secrets
from orrery.llm.tables import fresh, table, without
from orrery.session import written

#: Least posterior of the language named; documents below it, and those without letters, go.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named with a posterior of ``LEAST_SCORE`` or more, with their columns as they are.

    Null and empty texts and texts without letters have no language and go.
    Repeated rows are judged each; other columns may have any name.
    """
    to = tuple(fresh(docs, x) for x in ("_held_out", "_lang_pred", "_score"))
    found = language_id.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), to=to)
    return found.where((F.col(to[1]) != language_id.UND) & (F.col(to[2]) >= LEAST_SCORE)).select(*(f"`{x}`" for x in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; so do documents without words and null ids.

    Rows that share an id are one document and stay or go together.
    """
    return without(docs, near_dedup.near_dedup(docs).where("not kept").select("id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose words lie in windows of benchmark items by a twentieth or more; documents without words stay.

    Rows that share an id go if any of them is contaminated; null ids stay.
    """
    return without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; secrets in texts give way to a mark, and n_chars follows. Null texts stay null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast("long")) if "n_chars" in out.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences; null and empty texts are one end id, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
#: Hashing, sampling and tokenisation are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}-{name}")
    return docs
