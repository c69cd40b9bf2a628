"""Quality classifier by co-training of two views.

One view sees a text's content: shares of its bytes and byte pairs (hashed) and some measures of its words and lines. The
other sees what is known about the page besides: source, language, length. Each is a logistic model. In every round, each
scores all unlabelled rows and labels the PER_ROUND that it is most sure of, for the other to learn from; after the rounds
each view is calibrated on labelled rows it never learned from, and the mean of both calibrated log odds scores every document.

The models are fitted to about FIT_LABELLED labelled rows (the documented bound), chosen by a hash of the row, whatever ids
are null or repeated; rows that repeat are drawn as often as their share says. The search for pseudo-labels covers every
unlabelled row: their features are stored once, each task keeps its surest, and of those only the first PER_ROUND come back.
Rows that are equal are one candidate; among equal scores the row hash decides. Null text counts as empty; null source and
language are values of their own. Rows that repeat a doc_id are scored each on its own. Without labels of both kinds all scores
are 0.5. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_batches, map_arrow, stored, utf8

FIT_LABELLED, ROUNDS, PER_ROUND = 6000, 4, 150
PAIRS = 512
META = 64
CONTENT = 256 + PAIRS + 7


def content_features(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros((len(texts), CONTENT), np.float32)
    for k, text in enumerate(texts):
        if not text:
            out[k, -1] = 1
            continue
        raw = np.frombuffer(text, np.uint8)
        out[k, :256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
        pairs = raw[:-1].astype(np.uint32) << 8 | raw[1:]
        if len(pairs):
            out[k, 256 : 256 + PAIRS] = np.sqrt(np.bincount((pairs * np.uint32(2654435761)) >> np.uint32(23), minlength=PAIRS) / len(pairs))
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        few = max(1, len(words))
        out[k, -7:] = (
            min(1, len(set(words)) / few), min(1, sum(map(len, words)) / few / 20), len(set(lines)) / max(1, len(lines)),
            text.count(b"http") / few, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|")) / len(text), float(text.isupper()), 0,
        )
    return out


def meta_features(sources: list, langs: list, chars: np.ndarray) -> np.ndarray:
    """Source and language by hash, and the length in steps."""
    out = np.zeros((len(sources), META), np.float32)
    rows = np.arange(len(sources))
    out[rows, [zlib.crc32(repr(s).encode()) % 32 for s in sources]] = 1
    out[rows, [32 + zlib.crc32(repr(x).encode()) % 16 for x in langs]] = 1
    out[rows, 48 + np.minimum(14, np.log2(1 + chars).astype(int))] = 1
    out[:, 63] = np.log1p(chars) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, l2: float = 1e-3) -> Logistic:
        """Full-batch Adam on standardised columns, classes weighed alike."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 5e-3)
        z = self.standard(x)
        w = weight * np.where(y > 0, 0.5 / max(1e-9, (weight * y).sum()), 0.5 / max(1e-9, (weight * (1 - y)).sum()))
        self.coef, self.bias = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, steps + 1):
            error = w * (sigmoid(z @ self.coef + self.bias) - y)
            g = np.r_[z.T @ error + l2 * self.coef, error.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.coef, self.bias = self.coef - move[:-1], self.bias - move[-1]
        return self

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Columns in units of their spread; what is rare in the sample counts for 4 of these at most."""
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.coef + self.bias, -20, 20)


class Calibration:
    """Platt's: a sigmoid of a line through the logits, fitted to rows with known labels."""

    def fit(self, logit: np.ndarray, y: np.ndarray) -> Calibration:
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        line, x = np.zeros(2), np.c_[logit, np.ones(len(logit))]
        for _ in range(200):  # Newton steps of bounded length
            p = sigmoid(x @ line)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (p - target))
            line = line - step * min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        self.a, self.b = float(line[0]), float(line[1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * x + self.b


#: Rows that a round takes from the unlabelled ones: their hashes, content and metadata features, one row each.
Taken = tuple[np.ndarray, np.ndarray, np.ndarray]


def surest(logit: np.ndarray, row: np.ndarray, n: int, highest: bool) -> np.ndarray:
    """Places of the n highest or lowest logits among distinct rows; of equal ones the smallest hash first."""
    order = np.lexsort((row, -logit if highest else logit))
    first = np.zeros(len(row), bool)
    first[np.unique(row[order], return_index=True)[1]] = True
    return order[first][:n]


class CoTrained:
    def __init__(self, content: np.ndarray, meta: np.ndarray, label: np.ndarray, pick: Callable[[list[Logistic], int, int, np.ndarray], list[tuple[Taken, Taken]]], rounds: int = ROUNDS, per_round: int = PER_ROUND):
        """label: 1 or 0. pick(models, low, up, gone) gives for each view the low rows with its lowest logits and the up with its
        highest, of the unlabelled rows whose hashes are not in gone."""
        test = np.arange(len(label))[::4]
        learn = np.setdiff1d(np.arange(len(label)), test)
        self.views, self.taken = None, []
        if len(np.unique(label[learn])) < 2 or len(np.unique(label[test])) < 2:
            return
        views = [content, meta]
        taught = [(v[learn], label[learn].astype(float), np.ones(len(learn))) for v in views]
        up = max(1, round(per_round * float(label[learn].mean())))
        gone = np.empty(0, np.int64)
        for r in range(rounds + 1):
            models = [Logistic().fit(*t) for t in taught]
            if r == rounds:
                break
            chosen = pick(models, max(1, per_round - up), up, gone)
            self.taken.append([[part[0] for part in sides] for sides in chosen])
            for k, (low, high) in enumerate(chosen):
                x, y, w = taught[1 - k]
                n = len(low[0]), len(high[0])
                taught[1 - k] = (np.concatenate([x, low[2 - k], high[2 - k]]), np.r_[y, np.zeros(n[0]), np.ones(n[1])], np.r_[w, np.full(sum(n), 0.3)])
            gone = np.unique(np.concatenate([gone, *(part[0] for sides in chosen for part in sides)]))
        self.views = [(m, Calibration().fit(m.logit(v[test]), label[test])) for m, v in zip(models, views, strict=True)]

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by content, by metadata, by both."""
        if self.views is None:
            return (np.full(len(content), 0.5),) * 3
        logits = [c.logit(m.logit(x)) for (m, c), x in zip(self.views, (content, meta), strict=True)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid((logits[0] + logits[1]) / 2)


def _features(b: pa.RecordBatch, text_at: int, source_at: int, lang_at: int) -> tuple[np.ndarray, np.ndarray]:
    texts = utf8(b.column(text_at))
    chars = np.array([len(t) if t else 0 for t in texts], float)
    return content_features(texts), meta_features(b.column(source_at).to_pylist(), b.column(lang_at).to_pylist(), chars)


def row_hash(*columns: str) -> Column:
    """Equal for rows that are equal in these columns; nulls differ from values and by their column."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


FEATURES = "row long, content binary, meta binary"


def features(rows: DataFrame, *more: str) -> DataFrame:
    """row, more (longs), content and meta (float16) of rows(row, text, source, lang and more)."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        made = _features(b, 1, 2, 3)
        return pa.RecordBatch.from_arrays([b.column(0), *b.columns[4:], *(pa.array([x.astype(np.float16).tobytes() for x in m], pa.binary()) for m in made)], names=["row", *more, "content", "meta"])

    return map_arrow(rows.select("row", "text", "source", "lang", *more), step, ", ".join(["row long", *(f"{c} long" for c in more), "content binary", "meta binary"]))


def wide(values: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float16).reshape(-1, n).astype(np.float32)


def picker(pool: DataFrame) -> Callable[[list[Logistic], int, int, np.ndarray], list[tuple[Taken, Taken]]]:
    """The search of CoTrained in a stored table of FEATURES."""

    def pick(models: list[Logistic], low: int, up: int, gone: np.ndarray) -> list[tuple[Taken, Taken]]:
        sides = [(view, high, n) for view in range(2) for high, n in ((0, low), (1, up))]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(np.empty(0), np.empty(0, np.int64))] * len(sides)
            for b in batches:
                row = b.column(0).to_numpy().astype(np.int64)
                some = np.flatnonzero(~np.isin(row, gone))
                logits = [m.logit(wide(b.column(1 + k).to_pylist(), n))[some] for k, (m, n) in enumerate(zip(models, (CONTENT, META), strict=True))] if len(some) else [np.empty(0)] * 2
                for k, (view, high, n) in enumerate(sides):
                    logit, rows = np.r_[held[k][0], logits[view]], np.r_[held[k][1], row[some]]
                    at = surest(logit, rows, n, bool(high))
                    held[k] = logit[at], rows[at]
            for (view, high, _), (logit, rows) in zip(sides, held, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), 2 * view + high, np.int32)), pa.array(logit), pa.array(rows)], names=["side", "logit", "row"])

        found = in_batches(pool, best, "side int, logit double, row long").groupBy("side", "row").agg(F.min("logit").alias("logit"))
        # A task gives what a side takes at most; of these, only hashes come back.
        firsts = [[r["row"] for r in found.filter(F.col("side") == 2 * view + high).orderBy(F.col("logit").desc() if high else F.col("logit"), "row").limit(n).collect()] for view, high, n in sides]
        wanted = sorted({row for rows in firsts for row in rows})
        table = pool.filter(F.col("row").isin(wanted)).groupBy("row").agg(F.first("content").alias("content"), F.first("meta").alias("meta")).toPandas().set_index("row")
        taken = []
        for rows in firsts:
            own = table.loc[rows]
            taken.append((np.array(rows, np.int64), wide(own["content"].tolist(), CONTENT), wide(own["meta"].tolist(), META)))
        return [(taken[0], taken[1]), (taken[2], taken[3])]

    return pick


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_labelled: int = FIT_LABELLED) -> CoTrained:
    """docs: doc_id, text, source, lang; labels: doc_id and label_col (0 or 1)."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.select("doc_id", "text", "source", "lang", row_hash("doc_id", "text", "source", "lang").alias("row"))
    # Null ids meet no label: they are spread, so that no task gets them all.
    spread = lambda c: F.when(F.col("doc_id").isNull(), F.pmod(c, F.lit(4096))).otherwise(F.lit(0)).alias("spread")
    named = known.select("doc_id", F.lit(0).cast("long").alias("spread"), "label")
    named = F.broadcast(named) if known.count() <= BROADCAST_ROWS else named
    kinds = rows.select("doc_id", "row", spread(F.col("row"))).join(named, ["doc_id", "spread"], "left").select(F.coalesce("label", F.lit(-1)).alias("label"), "row")
    kinds = stored(kinds.groupBy("label", "row").agg(F.count("*").alias("n")), "quality-rows")
    per = {r["label"]: r["n"] for r in kinds.filter("label >= 0").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in per.items():
        share = F.when(F.col("label") == label, min(1.0, fit_labelled / 2 / n)).otherwise(share)
    # Of n equal rows n * share are drawn, rounded up or down by their hash: about as many rows as the bound says, whatever repeats.
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) / float(1 << 40)
    drawn = kinds.filter("label >= 0").withColumn("times", F.floor(F.col("n") * share + draw)).filter("times > 0").select("row", F.col("label").cast("long").alias("label"), "times")
    texts = rows.join(F.broadcast(drawn), "row").groupBy("row", "label", "times").agg(F.first("text").alias("text"), F.first("source").alias("source"), F.first("lang").alias("lang"))
    sample = features(texts, "label", "times").toPandas()
    sample = sample.loc[sample.index.repeat(sample["times"])].sort_values("row", key=lambda s: pd.util.hash_array(s.to_numpy())).reset_index(drop=True)
    unlabelled = rows.drop("doc_id") if not per else rows.join(named.withColumnRenamed("label", "_known"), "doc_id", "left_anti").drop("doc_id")
    pick = None if sample.empty else picker(stored(features(unlabelled), "quality-pool"))
    return CoTrained(wide(sample["content"].tolist(), CONTENT), wide(sample["meta"].tolist(), META), sample["label"].to_numpy(dtype=int), pick)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, content_score, meta_score, score, kept (score of least or more)."""
    model = fit(docs, labels)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        a, m, both = model.scores(*_features(b, 1, 2, 3))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(a.astype(float)), pa.array(m.astype(float)), pa.array(both.astype(float)), pa.array(both >= least)], names=["doc_id", "content_score", "meta_score", "score", "kept"])

    return map_arrow(docs.select("doc_id", "text", "source", "lang"), step, "doc_id long, content_score double, meta_score double, score double, kept boolean")
