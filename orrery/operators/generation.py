"""Prompts and generated images: prompt maps, fan-out, output names, placing and statistics."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import safe

CLASS_TOKEN = "<class>"
TEMPLATE = f"a photo of a {CLASS_TOKEN}"


def rendered(label: str, template: str = TEMPLATE) -> str:
    """A template with a class in it; both must hold something."""
    if not label.strip():
        raise ValueError("a class without a name")
    if CLASS_TOKEN not in template:
        raise ValueError(f"a template must hold {CLASS_TOKEN}")
    return template.strip().replace(CLASS_TOKEN, label.strip())


def parted(text: str) -> tuple[str | None, list[str]]:
    """``label: a, b`` as a label (lower case) and its prompts; without a colon there is no label."""
    head, colon, rest = text.strip().partition(":")
    label = head.strip().lower() or None if colon else None
    parts = [x.strip() for x in re.split(r"[\n.;,]", rest if colon else text.strip()) if x.strip()]
    return label, parts or ([head.strip()] if colon and head.strip() else [])


def prompt_map(text: str, template: str = TEMPLATE) -> dict[str, list[str]]:
    """Classes and their prompts: a JSON mapping, a JSON list of classes for the template, ``label: a, b``, or classes for the template."""
    if not text.strip():
        raise ValueError("a prompt is needed")
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    if isinstance(data, dict):
        every = {str(k).strip(): [str(x).strip() for x in (v if isinstance(v, list) else [v] if isinstance(v, str) else []) if str(x).strip()] for k, v in data.items()}
        out = {k: v for k, v in every.items() if k and v}
        if out:
            return out
    if isinstance(data, list) and any(str(x).strip() for x in data):
        return {str(x).strip(): [rendered(str(x), template)] for x in data if str(x).strip()}
    label, parts = parted(text)
    if not parts:
        raise ValueError("a prompt is needed")
    return {label: parts} if label else {p: [rendered(p, template)] for p in parts}


def prompt_table(prompts: list[str] | dict[str, str]) -> list[tuple[int, str, str]]:
    """(number, id, prompt): ids are those given, or four digits; ids that are one after cleaning fail."""
    rows = [(i, k, p.strip()) for i, (k, p) in enumerate(prompts.items())] if isinstance(prompts, dict) else [(i, f"{i:04d}", p.strip()) for i, p in enumerate(prompts)]
    clean = [re.sub("[^A-Za-z0-9._-]+", "_", k.strip()).strip("._") or "prompt" for _, k, _ in rows]
    if len(set(clean)) < len(clean) or any(not p for _, _, p in rows):
        raise ValueError("prompts must hold text and have ids that differ as file names")
    return [(i, c, p) for (i, _, p), c in zip(rows, clean)]


def _fanned(df: DataFrame, prompts: list[str] | dict[str, str], images: int) -> DataFrame:
    if images < 1:
        raise ValueError("at least one image for each prompt")
    rows = F.array(*(F.struct(F.lit(i).alias("prompt_index"), F.lit(k).alias("prompt_id"), F.lit(p).alias("prompt")) for i, k, p in prompt_table(prompts)))
    d = df.withColumn("_p", F.explode(rows)).select("*", "_p.*").drop("_p")
    return d.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(images))))


def created(spark, prompts: list[str] | dict[str, str], images: int = 1) -> DataFrame:
    """``(prompt_index, prompt_id, prompt, sample, key)``: each prompt as often as there are images of it."""
    d = _fanned(spark.range(1).select(F.lit(0).alias("_one")), prompts, images).drop("_one")
    return d.withColumn("key", F.concat_ws("_", "prompt_id", F.format_string("%04d", "sample")))


def edited(records: DataFrame, prompts: list[str] | dict[str, str], images: int = 1, number: str = "record_number", path: str = "path") -> DataFrame:
    """Every record with every prompt, as often as there are images; ``key`` names prompt, source and image."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    d = records.withColumn("source_key", F.concat_ws("_", F.format_string("%04d", F.col(number)), safe(stem, "prompt", lower=True)))
    return _fanned(d, prompts, images).withColumn("key", F.concat_ws("_", "prompt_id", "source_key", F.format_string("%04d", "sample")))


def placed(generated: DataFrame, folder: str = "generated", originals: str = "originals") -> DataFrame:
    """``(kind, src, dst)``: generated files are moved; each source is copied once."""
    ending = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"(\.[^./]+)$", 1), F.lit("")), F.lit(".png"))
    out = generated.select(F.lit("move").alias("kind"), F.col("file").alias("src"), F.concat(F.lit(f"{folder}/"), "key", ending("file")).alias("dst"))
    first = generated.where("source_key is not null").groupBy("source_key").agg(F.min("path").alias("path"))
    return out.unionAll(first.select(F.lit("copy"), "path", F.concat(F.lit(f"{originals}/"), "source_key", ending("path"))))


def statistics(generated: DataFrame) -> DataFrame:
    """One row: images, prompts, images of a prompt at most, and sources."""
    per = generated.groupBy("prompt_index").agg(F.count("*").alias("n"), F.max("sample").alias("s"))
    src = generated.agg(F.count("*").alias("generated_images"), F.countDistinct("source_key").alias("sources")) if "source_key" in generated.columns else generated.agg(F.count("*").alias("generated_images"), F.lit(0).cast("long").alias("sources"))
    return src.join(F.broadcast(per.agg(F.count("*").alias("prompt_count"), F.max("s").cast("long").alias("images_per_prompt"))))


def token(text: Column) -> Column:
    return safe(text, "prompt", lower=True)
