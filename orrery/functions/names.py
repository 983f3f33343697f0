"""Names, aliases and identifiers: file-safe keys, tasks, splits, class folders, output keys."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tasks and splits may be called.
TASKS = {
    "cls": "cls", "classification": "cls",
    "multi-cls": "multi-cls", "multi_cls": "multi-cls", "multi-class": "multi-cls", "multiclass": "multi-cls", "multi-label": "multi-cls", "multilabel": "multi-cls",
    "det": "det", "detect": "det", "detection": "det",
    "obb": "obb",
    "inst-seg": "inst-seg", "inst_seg": "inst-seg", "seg": "inst-seg", "segment": "inst-seg", "segmentation": "inst-seg",
    "sem-seg": "sem-seg", "sem_seg": "sem-seg", "semantic-seg": "sem-seg", "semantic-segmentation": "sem-seg",
    "pose": "pose", "keypoint": "pose", "keypoints": "pose",
}
SPLITS = {"train": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "eval": "test", "infer": "infer"}
PREFERRED = ("train", "val", "test")


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def task_id(raw: Column, strict: bool = True) -> Column:
    """The task a name stands for; empty is null, an unknown name fails (or is null)."""
    key = F.lower(F.trim(raw))
    unknown = F.raise_error(F.concat(F.lit("unknown task "), raw)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(_looked_up(key, TASKS), unknown))


def split_id(raw: Column, default: str = "train") -> Column:
    """The split a name stands for; empty and unknown names are ``default``."""
    return F.coalesce(_looked_up(F.lower(F.trim(raw)), SPLITS), F.lit(default))


def split_rank(split: Column) -> Column:
    """A sort key: train, val, test, then others by name."""
    place = F.coalesce(*(F.when(split == s, F.lit(i)) for i, s in enumerate(PREFERRED)), F.lit(len(PREFERRED)))
    return F.struct(place.alias("place"), split.alias("name"))


def safe(text: Column, default: str = "sample", lower: bool = False) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and dash become one underscore; dots and underscores at the edges go."""
    t = F.trim(text)
    t = F.regexp_replace(F.lower(t) if lower else t, "[^A-Za-z0-9._-]+", "_")
    t = F.regexp_replace(t, "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(default))


def sample_key(path: Column) -> Column:
    """The path without its ending, folders joined by two underscores."""
    return safe(F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), "/", "__"))


def label_folder(label: Column) -> Column:
    """A class name as a folder path: parts by slashes, spaces as underscores, no dots alone; an empty name is an underscore."""
    parts = F.transform(F.split(label, r"[\\/]+"), lambda x: F.regexp_replace(F.trim(x), " ", "_"))
    parts = F.filter(parts, lambda x: x != "")
    parts = F.transform(parts, lambda x: F.when(x == ".", "_").when(x == "..", "__").otherwise(x))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("_")


def crop_label(label: Column) -> Column:
    """A class name in a file name: slashes and spaces as underscores; an empty name is ``unnamed``."""
    return F.coalesce(F.nullif(F.regexp_replace(label, "[/ ]", "_"), F.lit("")), F.lit("unnamed"))


def prompt_text(prompt: Column) -> Column:
    """Lower case, trimmed, with a full stop."""
    t = F.trim(F.lower(prompt))
    return F.when(F.endswith(t, F.lit(".")), t).otherwise(F.concat(t, F.lit(".")))


def natural_key(text: str) -> tuple:
    """Sorts digit runs by their value: (0, number) or (1, letters) for each part."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", text.lower()) if x)


def numbered(df: DataFrame, key: str, order: str, to: str = "key") -> DataFrame:
    """Adds ``to``: the key, with ``#n`` from its second occurrence on, in order of ``order``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(to, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("#", F.col(key), n.cast("string"))))


def unique_keys(df: DataFrame, key: str, order: str, to: str = "unique_key") -> DataFrame:
    """Adds ``to``: keys made unique by ``_n``, first come first served in order of ``order``.

    A row's first try is its key, or ``key_n`` for the n-th repeat. Where such a
    name is itself a key of the table or another row's try, the row probes on.
    Rows can only meet within a family of keys that share a stem (the key without
    its trailing ``_digits``), so families are settled apart, each in one task.
    """
    stem = F.regexp_replace(F.col(key), r"(_\d+)+$", "")
    schema = df.withColumn(to, F.lit("")).schema

    def settle(g):
        g = g.sort_values(order)
        taken: set[str] = set()
        following: dict[str, int] = {}  # where a name's next repeat begins to probe
        out = []
        for name in g[key]:
            place = next(i for i in count(following.get(name, 0)) if (f"{name}_{i}" if i else name) not in taken)
            out.append(f"{name}_{place}" if place else name)
            taken.add(out[-1])
            following[name] = place + 1
        g[to] = out
        return g[schema.names]

    return df.groupBy(stem.alias("_stem")).applyInPandas(settle, schema)
