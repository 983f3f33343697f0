"""Free-text answers to labels, and routing of class probabilities."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand before an answer, where reasons begin, what an answer's edges lose, and how a lone letter or digit is given.
LEAD_INS = (r"final\s+answer\s*[:\-]", r"answer\s*[:\-]", r"the\s+answer\s+is\s", r"option\s*[:\-]?", r"choice\s*[:\-]?", r"label\s*[:\-]", r"class\s*[:\-]", r"category\s*[:\-]")
REASONS = ("because", "since", "but")
EDGES = " \t\r\n\"'`\u201c\u201d\u2018\u2019.,;:!?()[]{}<>"
LONE = r"^\s*[(\[]?\s*([A-Za-z0-9])\s*[)\]]?\s*[.!?]*\s*$"
NAMED = r"\b(?:option|choice|answer|pick|picked|choose|chose|select|selected|label|class|category)\s*[:\-]?\s*[(\[]?\s*([A-Za-z0-9])\s*[)\]]?\b"
UNCLEAR = "unclear"
_edges = "[" + re.escape(EDGES) + "]"


def plain(text: str) -> str:
    """The form in which answers and aliases are compared."""
    t = unicodedata.normalize("NFKC", text).casefold().replace("_", " ").replace("-", " ")
    return re.sub(r"\s+", " ", re.sub(r"\s+", " ", t).strip(EDGES)).strip()


def normalized(text: Column) -> Column:
    """``plain`` for answers in ASCII, as a column."""
    t = F.regexp_replace(F.lower(text), r"[_\-]", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(F.regexp_replace(t, f"^{_edges}+|{_edges}+$", ""))


@dataclass(frozen=True)
class Registry:
    """Labels in order, the last one unclear, and what each is called."""

    labels: tuple[str, ...]
    aliases: dict[str, str]

    @staticmethod
    def of(labels: list[str], aliases: dict[str, list[str]] | None = None) -> Registry:
        """Labels are relative folders; two labels that are called alike fail, as does no label at all."""
        names: list[str] = []
        for x in [*labels, *(aliases or {})]:
            x = str(x).strip()
            x = UNCLEAR if plain(x) == UNCLEAR else x
            if not x or x in names:
                continue
            if x.startswith("/") or any(p in ("", ".", "..") for p in x.split("/")):
                raise ValueError(f"a label must be a relative folder: {x!r}")
            names.append(x)
        names = [x for x in names if x != UNCLEAR] + [UNCLEAR]
        if len(names) == 1:
            raise ValueError("at least one label is needed")
        called: dict[str, str] = {}
        for label in names:
            for alias in [label, *(aliases or {}).get(label, [])]:
                form = plain(str(alias))
                if form and called.setdefault(form, label) != label:
                    raise ValueError(f"{alias!r} stands for {called[form]!r} and for {label!r}")
        return Registry(tuple(names), called)

    @property
    def lone(self) -> dict[str, str]:
        """Those called by one letter or digit."""
        return {k: v for k, v in self.aliases.items() if re.fullmatch("[a-z0-9]", k)}


def _trimmed(text: Column) -> Column:
    first = F.trim(F.substring_index(F.trim(text), "\n", 1))
    return F.trim(F.regexp_replace(first, rf"(?is)\b(?:{'|'.join(REASONS)})\b.*$", ""))


def _after(texts: Column, lead_in: str) -> Column:
    """What follows every place of the lead-in, for each of ``texts``."""
    mark = rf"(?i)\b{lead_in}\s*"
    each = F.transform(texts, lambda x: F.slice(F.split(x, mark), F.lit(2), F.greatest(F.size(F.split(x, mark)) - 1, F.lit(0))))
    # from a place on to the end of its text: the parts after it, with what stood between them lost, are tried in full too
    whole = F.transform(F.filter(texts, lambda x: x.rlike(mark)), lambda x: F.regexp_replace(x, rf"(?is)^.*?\b{lead_in}\s*", ""))
    last = F.transform(F.filter(each, lambda p: F.size(p) > 0), lambda p: F.element_at(p, -1))
    return F.array_distinct(F.concat(whole, last))


def _nfkc(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ``to``: the text in NFKC form and folded, in Arrow batches; only for texts beyond ASCII."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).replace("\u201c", '"').replace("\u201d", '"').replace("\u2018", "'").replace("\u2019", "'").casefold() if not t.isascii() else t)

    return df.withColumn(to, F.pandas_udf(run, "string")(F.col(column)))


def map_answers(df: DataFrame, answer: str, aliases: dict[str, str] | Registry, to: str = "label", ascii_only: bool = True) -> DataFrame:
    """``df`` with ``to``, ``rule`` and ``alias``: the label whose alias the answer is.

    The whole answer is tried first, then its first and last lines, what follows a
    lead-in, each of these without its reasons, and at last a letter or digit that
    stands alone or after a word of choice. The first stage with a match decides; a
    stage that matches several labels is unclear, as is an answer that matches
    none. With ``ascii_only`` false, texts beyond ASCII are normalised first.
    """
    called = aliases.aliases if isinstance(aliases, Registry) else {plain(k): v for k, v in aliases.items()}
    lone = {k: v for k, v in called.items() if re.fullmatch("[a-z0-9]", k)}
    table = F.from_json(F.lit(json.dumps(called)), "map<string,string>")
    letters = F.from_json(F.lit(json.dumps(lone)), "map<string,string>")
    d = df if ascii_only else _nfkc(df, answer, "_answer")
    text = F.coalesce(answer if ascii_only else "_answer", F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    edge = F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(lines, F.when(F.size(lines) > 0, 1).otherwise(None)), F.try_element_at(lines, F.lit(-1))))
    lead = F.filter(F.flatten(F.array(*(_after(F.array_append(lines, text), p) for p in LEAD_INS))), lambda x: F.trim(x) != "")
    found = F.concat(F.regexp_extract_all(text, F.lit(LONE), F.lit(1)), F.regexp_extract_all(text, F.lit("(?i)" + NAMED), F.lit(1)))
    d = d.withColumn("_whole", F.array(text)).withColumn("_edge", edge).withColumn("_lead", lead).withColumn("_lone", found)
    d = d.withColumn("_trim", F.filter(F.transform(F.concat("_whole", "_edge", "_lead"), _trimmed), lambda x: x != ""))
    stages = [("full_answer", "_whole", table), ("edge_lines", "_edge", table), ("leadin_span", "_lead", table), ("trimmed_span", "_trim", table), ("symbolic_token", "_lone", letters)]
    label, rule, alias = F.lit(UNCLEAR), F.when(normalized(text) == "", F.lit("empty")).otherwise(F.lit("no_match")), F.lit(None).cast("string")
    for name, col, of in reversed(stages):
        named = functools.partial(F.try_element_at, of)
        said = F.filter(F.transform(col, lambda x: normalized(x)), lambda x: named(x).isNotNull())  # noqa: B023
        d = d.withColumn(f"_s{col}", said).withColumn(f"_h{col}", F.array_distinct(F.transform(f"_s{col}", lambda x: named(x))))  # noqa: B023
        n = F.size(f"_h{col}")
        label = F.when(n == 1, F.get(f"_h{col}", F.lit(0))).when(n > 1, F.lit(UNCLEAR)).otherwise(label)
        alias = F.when(n == 1, F.get(f"_s{col}", F.lit(0))).when(n > 1, F.lit(None).cast("string")).otherwise(alias)
        rule = F.when(n == 1, F.lit(name)).when(n > 1, F.lit(f"{name}:ambiguous")).otherwise(rule)
    gone = ["_whole", "_edge", "_lead", "_trim", "_lone", "_answer", *(f"_{k}{c}" for _, c, _ in stages for k in "sh")]
    return d.withColumn(to, label).withColumn("rule", rule).withColumn("alias", alias).drop(*gone)


def route(probs: Column, threshold: float, by_class: dict[str, float] | None = None, unlabeled: str = "unlabeled") -> Column:
    """The most probable class (array of label, score; ties to the first) if any class reaches its threshold."""
    limit = lambda x: F.coalesce(*(F.when(x["label"] == k, F.lit(v)) for k, v in (by_class or {}).items()), F.lit(threshold))
    best = F.reduce(probs, F.element_at(probs, 1), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return F.when(F.exists(probs, lambda x: x["score"] >= limit(x)), best["label"]).otherwise(F.lit(unlabeled))


def route_all(probs: Column, threshold: float, unlabeled: str = "unlabeled") -> Column:
    """All classes that reach the threshold."""
    got = F.transform(F.filter(probs, lambda x: x["score"] >= threshold), lambda x: x["label"])
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(unlabeled)))
