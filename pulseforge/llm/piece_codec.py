"""SentencePiece encoding to the n best segmentations, and decoding.

The lattice of a text falls apart where no piece of the vocabulary can lie across: before a space that follows something
else, and around line feeds. So a text's n best are made of its words' best: the best takes each word's best, and the others
change at most n - 1 words, those with the smallest loss to their second best. Viterbi runs over many words at once and is
kept for words met before; A-star (see lattice.n_best) lists the segmentations of the few words that others need.

Scores are the model's; a character that no piece covers becomes its bytes, each with a score below all pieces'. Of equal
best paths the one with the longest last piece at each place is the first, whatever a word's length; further equal ones keep
the order of the search, which depends on the text alone. No segmentation is listed twice. Null and empty texts have no ids and no other
segmentations. U+2581 in a text comes back as a space, for which it stands. Rows that repeat a doc_id are rows of their own.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, Growing, Interned, map_arrow
from .language_id import default_vocabulary
from .lattice import SHORT, SPACE, Lattices, Pieces, n_best, pieces_of

N_BEST = 4
EDITS = "array<struct<at:int,drop:int,ids:array<int>>>"
_edits = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_others = pa.list_(pa.struct([("score", pa.float64()), ("edits", _edits)]))
_word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def words_of(text: str) -> list[str]:
    return _word.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Encoder:
    def __init__(self, model_file: str):
        self.pieces = pieces_of(model_file)
        self.score, self.loss = Growing(np.float64), Growing(np.float64)
        self.at, self.size, self.ids = Growing(np.int64), Growing(np.int64), Growing(np.int32)
        self.listed = lru_cache(maxsize=5_000)(lambda word, n: n_best(self.pieces, word, n))
        self.words = Interned(self.fill, self.forget, CACHE_WORDS)
        self.raw = np.frombuffer(b"".join(self.pieces.spelled), np.uint8)
        self.raw_size = np.array([len(x) for x in self.pieces.spelled], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def forget(self) -> None:
        for kept in (self.score, self.loss, self.at, self.size, self.ids):
            kept.clear()
        self.listed.cache_clear()

    def spelled(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """What each text's ids spell, with the space before the first word."""
        sizes = self.raw_size[flat]
        ends = np.cumsum(sizes)
        out = self.raw[np.repeat(self.raw_at[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def put(self, score, loss, ids, size) -> None:
        size = np.asarray(size, np.int64)
        self.at.extend(self.ids.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.ids.extend(np.asarray(ids, np.int32))
        self.score.extend(np.asarray(score, float))
        self.loss.extend(np.asarray(loss, float))

    def fill(self, words: list[str]) -> None:
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and end - at < 4096 and len(words[end]) <= SHORT:
                end += 1
            if end == at:  # a long word alone
                best = n_best(self.pieces, words[at], 2)
                self.put([best[0][0]], [best[0][0] - best[1][0] if len(best) > 1 else np.inf], best[0][1], [len(best[0][1])])
                at += 1
                continue
            self.short(words[at:end])
            at = end

    def short(self, words: list[str]) -> None:
        x, p = Lattices(self.pieces, words), self.pieces
        score = p.score[x.piece]
        bare = np.flatnonzero(x.piece < 0)
        raw = {int(e): [p.byte_ids[b] for b in words[x.word[e]][x.start[e]].encode("utf-8", "replace")] for e in bare}
        for e, ids in raw.items():
            score[e] = p.byte_score * len(ids)
        best, second, paths = x.best(score)
        ids = np.where(paths >= 0, x.piece[paths], -2)[:, ::-1]
        if len(bare) and (ids == -1).any():
            rows = []
            for path in paths[:, ::-1].tolist():
                rows.append([i for e in path if e >= 0 for i in (raw[e] if e in raw else [int(x.piece[e])])])
            self.put(best, best - second, [i for r in rows for i in r], [len(r) for r in rows])
        else:
            self.put(best, best - second, ids[ids >= 0], (ids >= 0).sum(axis=1))

    def encode(self, texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Flat ids, how many each text has, best scores, and the other segmentations."""
        found = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        number = self.words.numbers(words)
        doc = np.repeat(np.arange(len(texts)), sizes)
        lengths = self.size.data[number]
        ends = np.cumsum(lengths)
        flat = self.ids.data[np.repeat(self.at.data[number] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.bincount(doc, weights=lengths, minlength=len(texts)).astype(np.int64)
        scores = np.bincount(doc, weights=self.score.data[number], minlength=len(texts))
        losses, first, token = self.loss.data[number], np.cumsum(sizes) - sizes, ends - lengths
        others = []
        for k in range(len(texts)):
            if not sizes[k]:
                others.append([])
                continue
            a, b = first[k], first[k] + sizes[k]
            own = losses[a:b]
            if len(own) > 4 * n:  # all that could be among the n - 1 smallest, ties too
                near = np.flatnonzero(own <= np.partition(own, n - 2)[n - 2])
            else:
                near = np.arange(len(own))
            near = near[np.argsort(own[near], kind="stable")][: n - 1]
            near = [int(i) for i in near if np.isfinite(own[i])]
            lists = [self.listed(words[a + i], n) for i in near]
            others.append(
                [
                    {"score": float(scores[k] - lost), "edits": [{"at": int(token[a + i] - token[a]), "drop": int(lengths[a + i]), "ids": lists[j][c][1]} for j, (i, c) in enumerate(zip(near, choice, strict=True)) if c]}
                    for lost, choice in smallest_losses([[max(0.0, x[0][0] - y[0]) for y in x] for x in lists], n)[1:]
                ]
            )
        return flat, counts, scores, others


def smallest_losses(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n choices of one entry from each ascending list with the smallest sums, best first."""
    agenda, out = [(0.0, (0,) * len(lists), 0)], []
    while agenda and len(out) < n:
        lost, choice, last = heapq.heappop(agenda)
        out.append((lost, choice))
        for j in range(last, len(lists)):  # entries only move on from the last one moved, so each choice is met once
            c = choice[j] + 1
            if c < len(lists[j]):
                heapq.heappush(agenda, (lost + lists[j][c] - lists[j][c - 1], (*choice[:j], c, *choice[j + 1 :]), j))
    return out


def decoded(pieces: Pieces, ids: list[int]) -> str:
    return b"".join(map(pieces.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


_encoders: dict[str, Encoder] = {}


def _encoder(model_file: str) -> Encoder:
    if model_file not in _encoders:
        _encoders.clear()
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def encode(docs: DataFrame, columns: list[str], n: int = N_BEST, model_file: str | None = None, text_col: str = "text") -> DataFrame:
    """columns of docs, ids of the best segmentation, its score, and others: up to n - 1 further ones, best first, each as its
    score and the edits that make it of the best: from token at on, drop ids are replaced by others."""
    model_file = model_file or default_vocabulary()

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts, scores, others = _encoder(model_file).encode(b.column(b.num_columns - 1).to_pylist(), n)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array(scores), pa.array(others, _others)], names=[*columns, "ids", "score", "others"])

    kinds = dict(docs.dtypes)
    return map_arrow(docs.select(*columns, F.col(text_col).alias("_text")), step, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"ids array<int>, score double, others array<struct<score:double,edits:{EDITS}>>"]))


def with_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """A further segmentation from the best one's ids."""
    out, done = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += [*ids[done : e["at"]], *e["ids"]]
        done = e["at"] + e["drop"]
    return [*out, *ids[done:]]


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """encoded plus decoded: the text of ids, and others_agree: whether all other segmentations decode to it too."""
    model_file = model_file or default_vocabulary()
    names = encoded.columns
    ids_at, others_at = names.index("ids"), names.index("others")

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = pieces_of(model_file)
        texts, agree = [], []
        for ids, others in zip(b.column(ids_at).to_pylist(), b.column(others_at).to_pylist(), strict=True):
            texts.append(decoded(pieces, ids))
            agree.append(all(spelling(pieces, ids[e["at"] : e["at"] + e["drop"]]) == spelling(pieces, e["ids"]) for o in others for e in o["edits"]))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(agree)], names=[*names, "decoded", "others_agree"])

    return map_arrow(encoded, step, ", ".join([*(f"`{c}` {t}" for c, t in encoded.dtypes), "decoded string, others_agree boolean"]))


def spelling(pieces: Pieces, ids: list[int]) -> bytes:
    return b"".join(map(pieces.spelled.__getitem__, ids))


def codec_summary(docs: DataFrame, n: int = N_BEST, model_file: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, score, scores of the others, ids_hash, round_trip (decoding gives the text, from every
    segmentation). Encoding and decoding share a task, so that ids do not travel in between."""
    model_file = model_file or default_vocabulary()

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        encoder = _encoder(model_file)
        flat, counts, scores, others = encoder.encode(texts, n)
        spelled = encoder.spelled(flat, counts)
        first, good, hashes = np.cumsum(counts) - counts, [], []
        for k, text in enumerate(texts):
            own = flat[first[k] : first[k] + counts[k]]
            same = all(spelling(encoder.pieces, own[e["at"] : e["at"] + e["drop"]].tolist()) == spelling(encoder.pieces, e["ids"]) for o in others[k] for e in o["edits"])
            good.append(same and spelled[k][1:] == (text or "").replace(SPACE, " ").encode("utf-8", "replace"))
            hashes.append(xxhash.xxh3_64_intdigest(own.astype("<i4").tobytes()) >> 1)
        more = [pa.array([o[k]["score"] if len(o) > k else None for o in others], pa.float64()) for k in range(n - 1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(scores), *more, pa.array(hashes, pa.int64()), pa.array(good)], names=names)

    names = ["doc_id", "n_tokens", "score", *(f"score_{k}" for k in range(2, n + 1)), "ids_hash", "round_trip"]
    kinds = ["long", "long", "double", *["double"] * (n - 1), "long", "boolean"]
    return map_arrow(docs.select("doc_id", "text"), step, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))
