"""Language by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces, by
the forward algorithm; that of a text is the product over its words. Piece
probabilities come from expectation maximisation (forward and backward) over the
words of a bounded, hash-chosen sample of labelled training texts.

All pieces that occur in many words are found by one pass of an Aho-Corasick
automaton over them, and the forward sums advance one letter of all words at a
time. Values are scaled every few letters, so words of any length are summed.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm import bytewords as B
from orrery.llm.resident import only
from orrery.llm.tables import table

#: Training texts and words by language that the model is fitted on, at most about.
SAMPLE_TEXTS, SAMPLE_WORDS = 800, 20_000
EM_ROUNDS = 3
UNKNOWN = 1e-9
CACHE_WORDS = 400_000
#: Letters after which values are scaled, and numbers of a table of forward values worked on at once.
RESCALE, CELLS = 16, 1 << 20
UND = "und"
_word = re.compile(r"[^\W\d_]+")


def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces without control and byte pieces, numbered from 0; a leading U+2581 stands for a word's begin."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return {x: i for i, x in enumerate(dict.fromkeys(x.lower() for x in found))}


class Pieces:
    """Finds all pieces within words."""

    def __init__(self, vocab: dict[str, int]):
        self.n = len(vocab)
        self.automaton = ahocorasick.Automaton()
        for x, i in vocab.items():
            if "\n" not in x:
                self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        self.length = np.array([*map(len, vocab), 1], np.int64)
        self.longest = int(self.length.max())

    def lattice(self, words: list[str]) -> Lattice:
        text = "\n".join("\u2581" + x for x in words) + "\n"
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size + 1) - (size + 1)
        got = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, piece = got[:, 0] + 1, got[:, 1]
        start = end - self.length[piece]
        lone = np.zeros(len(text), bool)
        lone[start[self.length[piece] == 1]] = True
        lone[begin[1:] - 1] = lone[-1] = True  # line ends are no letters
        bare = np.flatnonzero(~lone)  # letters without a piece of their own
        start, end, piece = np.concatenate([start, bare]), np.concatenate([end, bare + 1]), np.concatenate([piece, np.full(len(bare), self.n)])
        word = np.searchsorted(begin, start, "right") - 1
        return Lattice(size, word, start - begin[word], end - begin[word], piece, self.longest)


@dataclass
class Lattice:
    """Edges (word, from, to, piece) of words of ``size`` places; every place is reached by an edge of one letter."""

    size: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    longest: int

    def mirrored(self) -> Lattice:
        n = self.size[self.word]
        return Lattice(self.size, self.word, n - self.end, n - self.start, self.piece, self.longest)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Log of the summed probabilities (words, places + 1, languages) of all ways from place 0 to each place.

        prob: (pieces + 1, languages), the last for a letter without a piece.
        """
        n, last = len(self.size), int(self.size.max())
        langs = prob.shape[1]
        order = np.argsort(self.end * n + self.word, kind="stable")
        word, start, end, piece = self.word[order], self.start[order], self.end[order], self.piece[order]
        key = end * n + word
        group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        edges = np.searchsorted(end, np.arange(1, last + 2))
        groups = np.searchsorted(end[group], np.arange(1, last + 2))
        a = np.zeros((n, last + 1, langs))
        a[:, 0] = 1.0
        out = np.zeros((n, last + 1, langs))
        scale = np.zeros((n, langs))
        for j in range(1, last + 1):
            e = slice(edges[j - 1], edges[j])
            g = group[groups[j - 1] : groups[j]]
            w = word[g]
            total = np.add.reduceat(a[word[e], start[e]] * prob[piece[e]], g - edges[j - 1], axis=0)
            a[w, j] = total
            out[w, j] = np.log(total) + scale[w]
            if j % RESCALE == 0:
                lo = max(0, j - self.longest)
                most = a[w, lo : j + 1].max(axis=1)
                a[w, lo : j + 1] /= most[:, None, :]
                scale[w] += np.log(most)
        return out

    def total(self, f: np.ndarray) -> np.ndarray:
        return f[np.arange(len(self.size)), self.size]


def in_chunks(words: list[str], langs: int) -> Iterator[list[int]]:
    """Places of words of about one length, few enough for one table."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (len(words[order[to]]) + 2) * (to - at + 1) * langs <= CELLS:
            to += 1
        yield order[at:to]
        at = to


def fit(words: dict[str, dict[str, int]], vocab: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and (pieces + 1, languages) probabilities, from word counts by language."""
    langs = sorted(words)
    n = len(vocab)
    prob = np.zeros((n + 1, len(langs)))
    prob[:n] = 1 / n
    prob[n] = UNKNOWN
    pieces = Pieces(vocab)
    for l, lang in enumerate(langs):
        names = sorted(words[lang])
        for _ in range(rounds):
            got = np.zeros(n + 1)
            for part in in_chunks(names, 4):
                some = [names[i] for i in part]
                weight = np.array([words[lang][x] for x in some], float)
                x = pieces.lattice(some)
                p = prob[:, l : l + 1]
                f, b = x.forward(p)[:, :, 0], x.mirrored().forward(p)[:, :, 0]
                whole = f[np.arange(len(some)), x.size]
                share = np.exp(f[x.word, x.start] + np.log(p[x.piece, 0]) + b[x.word, x.size[x.word] - x.end] - whole[x.word])
                got += np.bincount(x.piece, share * weight[x.word], minlength=n + 1)
            new = got[:n] + 0.01
            prob[:n, l] = new / new.sum()
    return langs, prob


def _training(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts by language of a bounded sample of labelled training texts."""
    train = docs.where("lang is not null and text is not null and crc32(cast(id as string)) % 4 <> 2")
    share = train.groupBy("lang").agg((F.lit(float(SAMPLE_TEXTS) * (1 << 30)) / F.count("*")).cast("long").alias("below"))
    sample = train.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("below"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(f"r <= {SAMPLE_WORDS}")
    found: dict[str, dict[str, int]] = defaultdict(dict)
    for x in best.collect():  # at most SAMPLE_WORDS rows a language
        found[x.lang][x.word] = x.n
    return found


class Scorer:
    """Log probabilities by word, each found once."""

    def __init__(self, langs: list[str], prob: np.ndarray, vocab: dict[str, int]):
        self.langs, self.prob, self.pieces = langs, prob, Pieces(vocab)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.langs)), np.float32)
        self.letters = np.zeros(1 << 12, bool)

    def _rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for part in in_chunks(words, max(1, len(self.langs))):
            x = self.pieces.lattice([words[i] for i in part])
            out[part] = x.total(x.forward(self.prob))
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log probabilities and the number of words with letters."""
        rows, n = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = _word.findall(text.lower())
                rows += found
                n[i] = len(found)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        at = np.fromiter((self.known.get(x, -1) for x in rows), np.int64, len(rows))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            new = list(dict.fromkeys(rows[i] for i in missed))
            old, now = len(self.known), len(self.known) + len(new)
            self.known.update(zip(new, range(old, now)))
            if now > len(self.rows):
                grown = max(now, 2 * len(self.rows))
                self.rows = np.concatenate([self.rows[:old], np.zeros((grown - old, len(self.langs)), np.float32)])
                self.letters = np.concatenate([self.letters[:old], np.zeros(grown - old, bool)])
            self.rows[old:now] = self._rows(new)
            self.letters[old:now] = [any(map(str.isalpha, x)) for x in new]
            at[missed] = [self.known[rows[i]] for i in missed]
        doc = np.repeat(np.arange(len(texts)), n)
        real = self.letters[at] if len(at) else np.zeros(0, bool)
        total = np.stack([np.bincount(doc[real], self.rows[at[real], l], minlength=len(texts)) for l in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return total, np.bincount(doc[real], minlength=len(texts))


def identify(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", to: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """``docs`` with a fold, a prediction and its score after its columns, named ``to`` (earlier columns of these names go).

    Learns from rows with a language and a text outside the held-out fold. Texts
    that are null or have no letter are ``und`` with score 0, as is every text
    where nothing could be learned. ``score`` is the posterior of the language
    named, under equal priors; ties go to the first by name. Words of any length
    are summed whole. Repeated rows give a row each; a null id is not held out;
    an empty table gives an empty result.
    """
    vocab = vocabulary(model_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast((*fit(_training(src), vocab), vocab))
    key = uuid.uuid4().hex
    kept = docs.drop(*(x for x in to if x in docs.columns))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = only(key, lambda: Scorer(*model.value))
        for batch in B.slices(batches, at, rows=500):
            total, n = scorer.score(batch.column(at).cast(pa.string()).to_pylist())
            named = n > 0 if scorer.langs else np.zeros(batch.num_rows, bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if named.any():
                best[named] = total[named].argmax(1)
                score[named] = 1 / np.exp(total[named] - total[named].max(1, keepdims=True)).sum(1)
            pred = [scorer.langs[b] if y else UND for b, y in zip(best.tolist(), named.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, *to[1:]])

    schema = StructType(list(kept.schema.fields)).add(to[1], "string").add(to[2], "double")
    held = F.expr(f"coalesce(crc32(cast(`{id_col}` as string)) % 4 = 2, false)")
    return kept.mapInArrow(run, schema).withColumn(to[0], held).select(*(f"`{x}`" for x in kept.columns), *to)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of all ``documents``, learned from their training folds."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")
