"""Document fingerprints from closed syncmers, in SQL functions only.

Tokens are runs of visible characters, lower-cased; ideographs and kana stand
alone and longer runs are cut. A run of five tokens is chosen where the least
hash of its four inner pairs is that of its first or last pair. Whether it is
chosen depends on its own tokens alone, so shared stretches of two texts choose
the same anchors wherever they lie. A fingerprint is the hashes of all chosen
runs in the order of the text, 32 bits each; an anchor is such a hash and its
place, so texts are compared by the runs they share and by those they share at
the same place. A text that chooses none is anchored at its pairs of tokens, or
at its only token.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.tables import table

TOKEN = r"[぀-ヿ㐀-鿿가-힯]|[^\s぀-ヿ㐀-鿿가-힯]{1,24}"
#: Rows of one window bucket, and buckets, at most about; beyond, buckets grow, and what a task cannot hold of one it spills.
BUCKET_ROWS, BUCKETS, FAN = 1500, 1 << 14, 128


def _pairs(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: hashes of neighbouring tokens, and ``to``_t: the tokens' hashes."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(f"{to}_t", F.transform(tokens, lambda x: F.xxhash64(x)))
    t, n = F.col(f"{to}_t"), F.greatest(F.size(f"{to}_t") - 1, F.lit(0))
    return df.withColumn(to, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def _windows(m: Column) -> Column:
    rest = lambda i: F.slice(m, F.lit(i), F.greatest(F.size(m) - (i - 1), F.lit(0)))
    return F.arrays_zip(m.alias("a"), rest(2).alias("b"), rest(3).alias("c"), rest(4).alias("d"))


def _closed(x: Column) -> Column:
    least = F.least(x["a"], x["b"], x["c"], x["d"])
    return x["d"].isNotNull() & ((least == x["a"]) | (least == x["d"]))


def _gram(x: Column) -> Column:
    return F.xxhash64(x["a"], x["c"], x["d"])


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, gram)``: each chosen run of five tokens by the place of its first; shared grams of two texts align them."""
    d = _pairs(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "_m")
    w = d.select("id", F.posexplode(_windows(F.col("_m"))).alias("pos", "x"))
    return w.where(_closed(F.col("x"))).select("id", "pos", _gram(F.col("x")).alias("gram"))


def with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: the chosen runs in order, each as 32 bits of its hash above its place."""
    d = _pairs(df, text, "_m")
    anchor = lambda g, i: F.shiftleft(g.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(i.cast("long"))
    chosen = F.transform(_windows(F.col("_m")), lambda x, i: F.when(_closed(x), anchor(_gram(x), i)))
    d = d.withColumn("_g", F.filter(chosen, lambda x: x.isNotNull()))
    fewer = F.transform(F.when(F.size("_m") > 0, F.col("_m")).otherwise(F.col("_m_t")), anchor)
    return d.withColumn(to, F.when(F.size("_g") > 0, F.col("_g")).otherwise(fewer)).drop("_g", "_m", "_m_t")


def runs(anchors: str) -> Column:
    """The hashes of anchors in order."""
    return F.transform(anchors, lambda x: F.shiftrightunsigned(x, 32))


def likeness(a: Column, b: Column) -> Column:
    """Of the distinct runs of either, the share that both have. Two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def printed(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"))), "")


def with_bucket(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Adds ``_bucket``, ranges of ``key`` of about equal rows, each beginning at a value that occurs, and ``_opens``, whether the row has that value; and how many ranges there are."""
    n = df.count()
    wanted = max(1, min(BUCKETS, math.ceil(n / BUCKET_ROWS)))
    at = [i / wanted for i in range(wanted)]
    found = df.agg(F.percentile_approx(key, at, 10 * BUCKETS), F.min(key)).first()
    first = sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})
    blocks = [first[i : i + FAN] for i in range(0, len(first), FAN)] or [[0]]
    heads = F.from_json(F.lit(json.dumps([x[0] for x in blocks])), "array<bigint>")
    tails = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
    block = F.greatest(F.size(F.filter(heads, lambda s: s <= F.col(key))), F.lit(1))
    df = df.withColumn("_block", block).withColumn("_in", F.get(tails, F.col("_block") - 1))
    df = df.withColumn("_at", F.greatest(F.size(F.filter("_in", lambda s: s <= F.col(key))), F.lit(1)) - 1)
    opens = F.coalesce(F.get("_in", F.col("_at")) >= F.col(key), F.lit(True))
    return df.withColumns({"_bucket": ((F.col("_block") - 1) * FAN + F.col("_at")).cast("int"), "_opens": opens}).drop("_block", "_in", "_at"), max(1, len(first))


def with_next(df: DataFrame, key: str, columns: list[str], prepare=lambda d: d) -> DataFrame:
    """``prepare(df)`` with ``next_c`` for each of ``columns``: the value in the row after, by ascending ``key``; after the last the first.

    Rows are dealt to ranges of the key, each ordered by itself; a range's last
    row gets the first of the next range by a join on the range, for which only
    the rows that open a range are read. Rows that share a key are in the order
    of the columns given; null keys come first.
    """
    dealt, n = with_bucket(df, key)
    order = [key, *columns]
    w = Window.partitionBy("_bucket").orderBy(*order)
    heads = prepare(dealt.where("_opens")).groupBy(((F.col("_bucket") + n - 1) % n).alias("_bucket")).agg(F.min(F.struct(*order)).alias("_head"))
    # rows are dealt before they are prepared, so that only ``df`` is shuffled
    d = prepare(dealt.drop("_opens").repartition("_bucket")).withColumn("_lead", F.lead(F.struct(*order)).over(w))
    d = d.join(heads, "_bucket", "left")
    for c in columns:
        d = d.withColumn(f"next_{c}", F.coalesce(F.col("_lead"), F.col("_head"))[c])
    return d.drop("_lead", "_head", "_bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors, n_in_place)``.

    Every text is compared with its edited text, whose last quarter (code points,
    rounded down) gives way to as much of the next text's begin, and with the
    next text: by the share of distinct chosen runs that both have. ``n_in_place``
    counts the anchors that text and edited text have at the same place. Null
    texts are empty; an empty text has an empty fingerprint, like only to another
    empty one. Rows that share an id follow each other in the order of their
    texts; repeated rows give a row each; a null id comes first; other columns
    are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = with_next(src, "doc_id", ["text", "anchors"], lambda x: with_anchors(x, "text", "anchors"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    d = with_anchors(d, "edited", "edited_anchors")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("anchors").alias("fingerprint"),
        printed("edited_anchors").alias("edited_fingerprint"),
        likeness(runs("anchors"), runs("edited_anchors")).alias("near_edited"),
        likeness(runs("anchors"), runs("next_anchors")).alias("near_next"),
        F.size("anchors").cast("long").alias("n_anchors"),
        F.size(F.array_intersect("anchors", "edited_anchors")).cast("long").alias("n_in_place"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
