"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from orrery.llm import decontaminate, fingerprints, language_id, licenses, near_dedup, packing, pitman_yor, secrets, simple8b
from orrery.session import written

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = "lorem ipsum dolor sit amet " * 40_000  # more than a million characters
ROWS = [
    (1, None, "en"),
    (2, "", None),
    (3, LONG, "en"),
    (4, "x" * 300_000, None),
    (5, "same words here and there again", "en"),
    (5, "same words here and there again", "en"),
    (6, "same words here and there again", None),
    (6, "other words by the same id", "en"),
    (None, "a text without an id of its own", "de"),
    (None, None, None),
]
CLASH = ("score", "lang_pred", "held_out", "_gone", "_hit", "_items", "_base", "_free", "row", "k1", "unit", "id", "_g", "_bucket", "_part")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return d.withColumns({c: F.lit(7.5) for c in CLASH})


BENCH = [(1, "same words here and there again"), (2, None), (3, "..."), (1, "same words here and there again")]

OPERATORS = {
    "fingerprints": lambda d, b: fingerprints.fingerprints(d),
    "simple8b": lambda d, b: simple8b.read_tokens(simple8b.write_tokens(d, BYTE, 2)),
    "licenses": lambda d, b: licenses.scan(licenses.document_paths(d.withColumn("source", F.lit("s")))),
    "pitman_yor": lambda d, b: pitman_yor.score(d, burn_in=0, sweeps=1),
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "secrets": lambda d, b: secrets.scan(d),
    "language_id": lambda d, b: language_id.identify(d, PIECE),
    "near_dedup": lambda d, b: near_dedup.near_dedup(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_every_row_has_a_result(spark, docs, name):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = OPERATORS[name](docs, bench).collect()
    assert len(out) == len(ROWS)
    key = "doc_id" if "doc_id" in out[0].asDict() else "id"
    assert Counter(r[key] for r in out) == Counter(r[0] for r in ROWS)
    twice = [r for r in out if r[key] == 5]
    if name not in ("fingerprints", "simple8b"):  # these depend on the row's neighbours
        assert twice[0] == twice[1]
    assert OPERATORS[name](docs.where("false"), bench).count() == 0
    assert OPERATORS["decontaminate"](docs, bench.where("false")).where("contaminated").count() == 0


def test_packing_of_odd_rows(docs):
    out = packing.pack(docs, WORD, 0).collect()
    assert Counter(r.id for r in out if r.piece == 0) == Counter(r[0] for r in ROWS)
    assert sum(r.length for r in out if r.id == 1) == 1


def test_token_starts_are_defined_where_ids_repeat(docs):
    once = sorted(map(tuple, simple8b.read_tokens(simple8b.write_tokens(docs, BYTE, 2)).collect()), key=str)
    again = sorted(map(tuple, simple8b.read_tokens(simple8b.write_tokens(docs.repartition(5), BYTE, 2)).collect()), key=str)
    assert once == again


def test_near_duplicates_of_rows_that_share_an_id(docs):
    got = {(r.id, r.n_shingles): r.component_id for r in near_dedup.near_dedup(docs.where("doc_id in (5, 6)")).collect()}
    assert set(got.values()) == {5}


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, docs, stage, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    d = docs.drop("id") if name == "best_fit_packing" else docs
    out = f(spark, d, f"file://{tmp_path}")
    if stage + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == d.columns
    got = written(out, "odd").collect()
    if name == "language_id":
        assert {r.doc_id for r in got} >= {3, 5} and not {r.doc_id for r in got} & {1, 2}
    if name == "near_dedup":
        assert Counter(r.doc_id for r in got)[5] == 2 and 1 in {r.doc_id for r in got} and all(r.score == 7.5 for r in got)
    if name == "decontaminate":
        assert not {r.doc_id for r in got} & {5, 6} and {1, 2, 3, None} <= {r.doc_id for r in got}
    if name == "secret_scan":
        assert len(got) == len(ROWS)
    assert f(spark, d.where("false"), f"file://{tmp_path}").count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_the_pipeline_is_its_plain_version(spark):
    """All stages over the smallest tables against loops over Python lists; language and secrets by their own functions."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = [r.text or "" for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table, PIECE).collect()}
    kept = {i: t for i, t in docs.items() if found[i][0] != "und" and found[i][1] >= corpus_pipeline.LEAST_SCORE}

    spaced = re.compile("[^\x20\x09-\x0d]+")
    sets = {}
    for i, t in kept.items():
        w = spaced.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}

    windows, shorts = set(), set()
    for t in bench:
        w = WORDS.findall(t.translate(LOW))
        n = min(13, len(w))
        (windows if n == 13 else shorts).update(tuple(w[a : a + n]) for a in range(len(w) - n + 1) if n)
    clean = {}
    for i, t in kept.items():
        w, hit = WORDS.findall((t or "").translate(LOW)), set()
        for n in {13, *map(len, shorts)}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in (windows if n == 13 else shorts):
                    hit |= set(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t

    grammar = secrets.learn(table.where(F.col("doc_id").isin(list(clean))).select(F.col("doc_id").alias("id"), "text"))
    ready = {r.doc_id: r.text for r in secrets.redact(table.where(F.col("doc_id").isin(list(clean))), grammar=grammar).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    want = {}
    for i, t in ready.items():
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(math.ceil(len(x) / 2048)):
            part = x[2048 * p : 2048 * (p + 1)]
            want[i, p] = (2048 * p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    full = Counter()
    for r in got:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048 and len(full) <= math.ceil(sum(full.values()) / 2048) * 1.02 + 1


def test_cosines_are_those_of_plain_tf_idf(spark):
    rows = [(1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person"), (2, "a/x.py", "# Copyright me\n# Licensed under the Apache License, Version 2.0.\ncode"), (3, "b/COPYING", "do what you like"), (3, "b/COPYING", "do what you like"), (4, "a/y", "code")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    terms = lambda s: [x for x in re.split("[^a-z0-9]+", s.lower()) if x]
    tidy = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    units = {
        1: [tidy("MIT License"), tidy(rows[0][2].split("\n")[2]), tidy(rows[0][2])],
        2: [tidy("# Copyright me"), tidy("# Licensed under the Apache License, Version 2.0."), tidy("Copyright me Licensed under the Apache License, Version 2.0. code")],
        3: [tidy(rows[2][2])],
    }
    every = [*units[1], *units[2], *units[3], *units[3]]
    df = Counter(t for u in every for t in set(terms(u)))
    idf = lambda t: math.log((1 + len(every)) / (df[t] + 1)) + 1

    def cosine(u, v):
        a, b = ({t: n * idf(t) for t, n in Counter(terms(x)).items()} for x in (u, v))
        return sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    for r in got:
        if r.doc_id in units:
            best = max(cosine(u, v) for u in units[r.doc_id] for _, v in licenses.TEMPLATE_LINES)
            assert (r.own_cosine is None and best < licenses.LEAST) or abs(r.own_cosine - best) < 0.05, (r, best)


def test_the_pipeline_learns_secrets_from_all_strings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    keys = ["".join(rng.choice(list("abcdef0123456789XYZ"), 20)) for _ in range(700)]
    seen = []
    monkeypatch.setattr(secrets.Automaton, "fit", lambda self, counts, fit=secrets.Automaton.fit: (seen.append(int(counts[:, secrets.EDGE].sum())), fit(self, counts))[1])
    d = spark.createDataFrame([(i, f"plain wordsofmany letters{'abcdefgh'[i % 8:]} token={k}") for i, k in enumerate(keys)], "doc_id long, text string")
    out = [r.text for r in corpus_pipeline.redact_secrets(spark, d, "").collect()]
    assert seen == [sum(not secrets.held_out(k) for k in keys)]  # more than any sample of 400
    assert len(out) == 700 and all(x.endswith("<secret>") for x in out)
