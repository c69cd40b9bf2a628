"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters of any length,
lower case). Sums are scaled by GAIN per letter, so that none leaves the range of floats, whatever a word's length and letters.
Expectation maximisation over the same lattices fits the probabilities to the word counts of about FIT_DOCS labelled documents
per language (the only sample), never of held-out ones. They are chosen by a hash of the whole row, and of equal rows as many
as their share says, so that the bound holds whatever ids or texts repeat.

A text without a letter, or null, is `und` with score 0. Among equal languages the first in code point order is predicted.
Without anything to learn from, all is `und`. doc_id may be null (then held out) or repeat; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, Growing, Interned, in_batches, map_arrow, slices, stored
from .lattice import SHORT, SPACE, Lattices, Pieces, pieces_of, scaled_sums

FIT_DOCS = 400
ROUNDS = 3
#: Words that a score speaks for: it is the posterior of as many average words of the text.
SCORE_WORDS = 20
UNKNOWN = 1e-9
#: Factor per letter in the sums of words of up to SHORT letters. No prefix has a sum above 1, and no piece or letter is below
#: UNKNOWN: with it, sums of words lie between 1e-245 and 1e196.
GAIN = 1e4

_letters = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    return _letters.findall(text.lower())


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


class Model:
    """probs: [piece, language], the row after the last for characters outside the vocabulary."""

    def __init__(self, langs: list[str], probs: np.ndarray, vocabulary: str):
        self.langs, self.probs, self.vocabulary, self.key = langs, probs, vocabulary, uuid.uuid4().hex


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs(lang, text, times)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                seen: Counter = Counter()
                for lang, text, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for u, n in Counter(units(text)).items():
                        seen[lang, u] += n * times
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    return in_batches(docs.select("lang", "text", "times"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame, text_col: str, lang_col: str, id_col: str, fit_docs: int) -> DataFrame:
    """(lang, text, times) of about fit_docs rows of each language: of n equal rows n times the language's share, rounded up or down by their hash."""
    learn = docs.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, lang_col, text_col).alias("row"))
    kinds = stored(learn.groupBy("lang", "row").agg(F.count("*").alias("n")), "language-rows")
    share = F.lit(float(fit_docs)) / F.col("rows")
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) / float(1 << 40)
    totals = kinds.groupBy("lang").agg(F.sum("n").alias("rows"))  # a row per language, as the model has a column
    drawn = kinds.join(F.broadcast(totals), "lang").withColumn("times", F.floor(F.col("n") * F.least(share, F.lit(1.0)) + draw)).filter("times > 0").select("lang", "row", "times")
    return learn.join(F.broadcast(drawn), ["lang", "row"]).groupBy("lang", "row", "times").agg(F.first("text").alias("text"))


def edge_probabilities(x: Lattices, probs: np.ndarray) -> np.ndarray:
    return probs[x.piece] * GAIN ** (x.end - x.start)[:, None]


def expected_pieces(x: Lattices, weight: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words, by weight[word, language]; a gain is the same for all paths of a word."""
    p, out = edge_probabilities(x, probs), np.zeros_like(probs)
    alpha, beta = x.forward_sums(p), x.backward_sums(p)
    for c in range(probs.shape[1]):
        all_paths = alpha[x.length, c, np.arange(x.count)]
        each = alpha[x.start, c, x.word] * p[:, c] * (beta[x.end, c, x.word] / all_paths[x.word])
        out[:, c] = np.bincount(np.where(x.piece < 0, len(probs) - 1, x.piece), weights=each * weight[x.word, c], minlength=len(probs))
    return out


def expected_in_long(pieces: Pieces, word: str, weight: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """The same of one word of any length, by logarithms."""
    edges, logs = pieces.edges(word), np.log(probs)
    front, back = (np.full((len(word) + 1, probs.shape[1]), -np.inf) for _ in range(2))
    front[0] = back[len(word)] = 0.0
    for a, b, piece in sorted(edges, key=lambda e: e[1]):
        front[b] = np.logaddexp(front[b], front[a] + logs[piece])
    for a, b, piece in sorted(edges, key=lambda e: -e[0]):
        back[a] = np.logaddexp(back[a], back[b] + logs[piece])
    out = np.zeros_like(probs)
    for a, b, piece in edges:
        out[piece] += weight * np.exp(front[a] + logs[piece] + back[b] - front[len(word)])
    return out


def fit(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    counts = word_counts(sampled(docs, text_col, lang_col, id_col, fit_docs)).toPandas()
    # A language whose rows drawn have no word has no column of its own.
    langs = sorted(set(counts["lang"]))
    if not langs:
        return Model([], np.zeros((0, 0)), vocabulary)
    pieces, column = pieces_of(vocabulary), {lang: k for k, lang in enumerate(langs)}
    words = sorted(set(counts["word"]))
    row = {w: k for k, w in enumerate(words)}
    weights = np.zeros((len(words), len(langs)))
    np.add.at(weights, (counts["word"].map(row).to_numpy(dtype=np.int64), counts["lang"].map(column).to_numpy(dtype=np.int64)), counts["n"].to_numpy(dtype=float))
    probs = np.full((pieces.size + 1, len(langs)), 1.0 / pieces.size)
    probs[-1] = UNKNOWN
    short = [k for k, w in enumerate(words) if len(w) < SHORT]
    parts = [(Lattices(pieces, [SPACE + words[k] for k in short[a : a + 8192]]), weights[short[a : a + 8192]]) for a in range(0, len(short), 8192)]
    for _ in range(ROUNDS):
        expected = np.zeros_like(probs)
        for x, weight in parts:
            expected += expected_pieces(x, weight, probs)
        for k in sorted(set(range(len(words))) - set(short)):
            expected += expected_in_long(pieces, SPACE + words[k], weights[k], probs)
        expected = expected[:-1]
        shared = expected.sum(axis=1, keepdims=True)
        # What a language lacks falls back on all languages' shares, and on a floor.
        smooth = expected / np.maximum(expected.sum(axis=0), 1e-9) + 1e-3 * shared / max(shared.sum(), 1e-9) + 1e-8
        probs[:-1] = smooth / smooth.sum(axis=0)
    return Model(langs, probs, vocabulary)


class _Scorer:
    """Log probabilities of the words met so far by a worker, by language; the last column counts words with a letter."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.vocabulary)
        self.values = Growing(np.float64, len(model.langs) + 1)
        self.words = Interned(self.fill, self.values.clear, CACHE_WORDS)

    def fill(self, words: list[str]) -> None:
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            long = [k for k, w in enumerate(part) if len(w) >= SHORT]
            x = Lattices(self.pieces, [SPACE + w if len(w) < SHORT else SPACE for w in part])
            alpha = x.forward_sums(edge_probabilities(x, self.model.probs))
            logs = np.log(alpha[x.length, :, np.arange(x.count)]) - x.length[:, None] * np.log(GAIN)
            for k in long:
                logs[k] = scaled_sums(self.pieces, SPACE + part[k], self.model.probs)
            letter = np.array([any(map(str.isalpha, w)) for w in part], float)
            self.values.extend(np.c_[logs * letter[:, None], letter])

    def totals(self, texts: list[str | None]) -> np.ndarray:
        found = [units(t) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found])
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        number = self.words.numbers([w for f in found for w in f])
        if len(number):
            doc, values = np.repeat(np.arange(len(texts)), sizes), self.values.data
            for c in range(out.shape[1]):
                out[:, c] = np.bincount(doc, weights=values[number, c], minlength=len(texts))
        return out


_scorers: dict[str, _Scorer] = {}


def _scorer(model: Model) -> _Scorer:
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = _Scorer(model)
    return _scorers[model.key]


def predicted(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    totals = _scorer(model).totals(texts)
    words, logs = totals[:, -1], totals[:, :-1]
    logs = logs / np.maximum(words, 1)[:, None] * np.minimum(words, SCORE_WORDS)[:, None]
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    best = odds.argmax(axis=1)
    score = np.where(words > 0, 1.0 / odds.sum(axis=1), 0.0)
    return [model.langs[b] if w > 0 else "und" for b, w in zip(best, words, strict=True)], score


def identify(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs, lang_pred and score."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predicted(b.column(b.num_columns - 1).to_pylist(), model)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    wide = docs.select(*columns, F.col(text_col).alias("_text"))
    return map_arrow(wide, step, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "lang_pred string, score double"]))


def language_id(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text, lang)."""
    model = fit(docs, vocabulary or default_vocabulary())
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def speakable(docs: DataFrame, vocabulary: str | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) with a predicted language and a score of least or more, as they are."""
    model = fit(docs, vocabulary or default_vocabulary())
    at = docs.columns.index(text_col)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predicted(b.column(at).to_pylist(), model)
        return b.filter(pa.array((np.array(lang) != "und") & (score >= least)))

    return map_arrow(docs, step, docs.schema)
