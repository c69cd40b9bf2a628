"""Hard negatives by norm-bucketed search.

A vector's components become floor(scale * x); a score is the inner product of two such vectors, an exact integer. An anchor's
positives are the first k other rows of its label, by score (ties: smaller vec_id). For each anchor and positive, the negatives
are the first k rows of other labels whose score lies between low and high per cent of the positive's.

Candidates are sorted by norm, ranges of them go to groups, and each group is cut into buckets. By Cauchy-Schwarz no score
of a bucket is above the anchor's norm times the bucket's largest. A block of anchors is sent to a group only if that bound
reaches the lower limit of one of its windows; in the group, buckets come by falling norm, and one is left out for each
anchor whose bound is below its window's lower limit or its running k-th score. Anchors, too, are packed into blocks by
norm. A group and a block are bounded in rows, whatever vector, norm, label or id repeats; they meet by a shuffle, one block
after another, and nothing is collected. The groups' best are merged by window.

Rows with a null vec_id, a null label, a null vector, or a component that is null or not finite (also after scaling) take no
part. Rows that repeat a vec_id are rows of their own, each an anchor if its id is one; an anchor's others are the rows of other ids.
Vectors of different lengths are compared as if the shorter ended in zeros. Scores beyond 2**61 either way count as that.
Positives below zero have an empty window. Without anchors or candidates the result is empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, map_arrow, stored

BUCKET_ROWS, BUCKETS, BLOCK_ROWS = 2048, 8, 256
#: Blocks that meet a group in one task; with more of them, the group is sent to several.
TASK_BLOCKS = 4096
#: Room for the rounding of norms.
SLACK = 1 + 1e-9
NONE, MOST, LAST_ID = -(1 << 62), 1 << 61, (1 << 63) - 1

PREPARED = "vec_id long, label long, norm double, wide boolean, v binary"
PACKED = "grp long, at long, hi double, n int, width int, wide boolean, ids binary, labels binary, norms binary, vecs binary"


def quantised(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """PREPARED rows of those that take part; v has float32 or (wide) float64, either of which holds its integers exactly."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, vectors = b.columns
        sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            bad = np.bincount(row, weights=~np.isfinite(x), minlength=b.num_rows) > 0
            norm = np.sqrt(np.bincount(row, weights=np.where(np.isfinite(x), x, 0) ** 2, minlength=b.num_rows))
        wide = norm >= 1 << 24
        there = ~bad & np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(vectors.is_valid())
        ends = np.cumsum(sizes)
        at = np.flatnonzero(there)
        v = [x[ends[k] - sizes[k] : ends[k]].astype("<f8" if wide[k] else "<f4").tobytes() for k in at]
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([ids.take(take), labels.take(take), pa.array(norm[at]), pa.array(wide[at]), pa.array(v, pa.binary())], names=["vec_id", "label", "norm", "wide", "v"])

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col)), step, PREPARED)


class Packed:
    """Some rows' ids, labels, norms and vectors (a matrix); hi: the largest norm."""

    def __init__(self, hi: float, n: int, width: int, wide: bool, ids: bytes, labels: bytes, norms: bytes, vecs: bytes):
        self.hi, self.ids, self.labels, self.norms = hi, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(norms, "<f8")
        self.vecs = np.frombuffer(vecs, "<f8" if wide else "<f4").reshape(n, width)


def packed(rows: DataFrame, per_bucket: int, per_group: int) -> DataFrame:
    """PACKED rows, each of per_bucket rows at most, which follow each other by falling norm; grp has per_group buckets at most."""
    n = rows.count()
    # Rows that are equal in norm and id are told apart by their place in the table, so that a range never has to take them all.
    order = [F.col("norm").desc(), F.col("vec_id"), F.monotonically_increasing_id()]
    parts = max(1, -(-n // (per_bucket * per_group)))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(F.col("norm").desc(), "vec_id").withColumn("part", F.spark_partition_id().cast("long"))

    def bucket(held: list[tuple], part: int, k: int) -> list:
        held.sort(key=lambda r: r[0])  # ties of a score are found in the order of ids
        wide = any(r[3] for r in held)
        vectors = [np.frombuffer(r[4], "<f8" if r[3] else "<f4") for r in held]
        matrix = np.zeros((len(held), max(map(len, vectors))), "<f8" if wide else "<f4")
        for to, v in zip(matrix, vectors, strict=True):
            to[: len(v)] = v
        ids, labels, norms = (np.array([r[c] for r in held], kind).tobytes() for c, kind in ((0, "<i8"), (1, "<i8"), (2, "<f8")))
        return [(part << 31) + k // per_group, k, max(r[2] for r in held), len(held), matrix.shape[1], wide, ids, labels, norms, matrix.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = k = 0
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        names = [x.split()[0] for x in PACKED.split(", ")]
        made = lambda row: pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)
        for b in batches:
            for *row, part in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                held.append(tuple(row))
                if len(held) == per_bucket:
                    yield made(bucket(held, part, k))
                    held, k = [], k + 1
        if held:
            yield made(bucket(held, part, k))

    return in_batches(ranged.select("vec_id", "label", "norm", "wide", "v", "part"), run, PACKED)


def scores(a: np.ndarray, a_hi: float, b: Packed) -> np.ndarray:
    """Inner products of a's rows with b's, as exact integers: no sum on the way to one is above the norms' product."""
    width, most = min(a.shape[1], b.vecs.shape[1]), a_hi * b.hi * SLACK
    a, c = a[:, :width], b.vecs[:, :width].T
    if most < 1 << 24:
        return (a.astype(np.float32, copy=False) @ c.astype(np.float32, copy=False)).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64)).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole(c.T)] for p in whole(a)], dtype=object).reshape(len(a), c.shape[1])
    return np.clip(exact, -MOST, MOST).astype(np.int64)


class Best:
    """The k best scores, and their ids, of each of some searches; kth: the running k-th score."""

    def __init__(self, searches: int, k: int):
        self.k, self.score, self.id = k, np.full((searches, k), NONE, np.int64), np.full((searches, k), LAST_ID, np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, s: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """s, fits: a row for each of rows, a column for each of ids, which ascend."""
        n, few = s.shape[1], min(self.k, s.shape[1])
        if np.abs(s).max(initial=0) < 1 << 50:
            key = np.where(fits, s * n + np.arange(n)[::-1], NONE)
            at = np.argpartition(key, n - few, axis=1)[:, n - few :]
        else:
            at = np.argsort(np.where(fits, -s, MOST << 1), axis=1, kind="stable")[:, :few]
        fit = np.take_along_axis(fits, at, 1)
        score = np.c_[self.score[rows], np.where(fit, np.take_along_axis(s, at, 1), NONE)]
        which = np.c_[self.id[rows], np.where(fit, ids[at], LAST_ID)]
        order = np.lexsort((which, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(which, order, 1)


def positives_of(block: Packed, buckets: list[Packed], k: int) -> Best:
    best = Best(len(block.ids), k)
    for b in buckets:
        rows = np.flatnonzero(~(block.norms * b.hi * SLACK < best.kth))
        if not len(rows):
            break  # what follows has smaller norms
        s = scores(block.vecs[rows], block.hi, b)
        best.add(rows, s, (block.labels[rows, None] == b.labels) & (block.ids[rows, None] != b.ids), b.ids)
    return best


def negatives_of(block: Packed, buckets: list[Packed], k: int, anchor: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> Best:
    """anchor, place (of the positive), least, most: of each window; an anchor has one window at most of a place."""
    best = Best(len(anchor), k)
    for b in buckets:
        need = np.maximum(least, best.kth)
        alive = ~(block.norms[anchor] * b.hi * SLACK < need)
        if not alive.any():
            break
        anchors = np.unique(anchor[alive])
        s = scores(block.vecs[anchors], block.hi, b)
        other = block.labels[anchors, None] != b.labels
        for j in np.unique(place[alive]):
            w = np.flatnonzero(alive & (place == j))
            own = np.searchsorted(anchors, anchor[w])
            fits = other[own] & (s[own] >= need[w, None]) & (s[own] <= most[w, None])
            some = fits.any(axis=1)
            if some.any():
                best.add(w[some], s[own[some]], fits[some], b.ids)
    return best


FOUND = "block long, anchor int, place int, id long, score long"


def search(buckets: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """FOUND rows: of each group the k best of each window. blocks: PACKED rows, block, windows, limit (below which nothing counts).

    The length bound: a block goes only to groups in which some score can reach its limit.
    """
    # One row per group: as many as the candidates have rows, divided by those of a group.
    groups = buckets.groupBy("grp").agg(F.max("hi").alias("top")).withColumnRenamed("grp", "to")
    near = blocks.join(groups, ~(F.col("hi") * F.col("top") * SLACK < F.col("limit")))
    shares = -(-blocks.count() // TASK_BLOCKS) or 1
    rows = buckets.select("grp", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), *PACKED_COLUMNS, F.lit(None).cast(WINDOWS).alias("windows"))
    sent = near.select(F.col("to").alias("grp"), F.pmod(F.hash("block"), F.lit(shares)).alias("share"), F.lit(1).alias("kind"), F.col("block"), *PACKED_COLUMNS, "windows")
    dealt = rows.unionByName(sent).repartition("grp", "share").sortWithinPartitions("grp", "share", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Packed] = []
        group = None
        for batch in batches:
            for r in batch.to_pylist():
                one = Packed(*(r[c] for c in PACKED_COLUMNS[1:]))
                if r["kind"] == 0:
                    key = r["grp"], r["share"]
                    held, group = [*held, one] if group == key else [one], key
                    continue
                if r["windows"] is None:
                    best = positives_of(one, held, k)
                    anchor, place = np.arange(len(one.ids)), np.zeros(len(one.ids), np.int64)
                else:
                    anchor, place, least, most = (np.array([w[c] for w in r["windows"]], np.int64) for c in ("anchor", "place", "least", "most"))
                    best = negatives_of(one, held, k, anchor, place, least, most)
                w, at = np.nonzero(best.score > NONE)
                columns = [np.full(len(w), r["block"], np.int64), anchor[w].astype(np.int32), place[w].astype(np.int32), best.id[w, at], best.score[w, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "anchor", "place", "id", "score"])

    return in_batches(dealt, run, FOUND)


PACKED_COLUMNS = [x.split()[0] for x in PACKED.split(", ")][1:]
WINDOWS = "array<struct<anchor: int, place: int, least: bigint, most: bigint>>"


def first(found: DataFrame, k: int, *key: str) -> DataFrame:
    """The first k by score of each key, numbered by place from 0; a task keeps k of a key before the shuffle."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
    return found.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k)


def hard_negatives(
    df: DataFrame, anchors: Column, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", per_bucket: int = BUCKET_ROWS, per_group: int = BUCKETS, per_block: int = BLOCK_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows are anchors, a condition on vec_id and label."""
    rows = stored(quantised(df, scale, id_col, label_col, vector_col), "negatives-rows")
    buckets = stored(packed(rows, per_bucket, per_group), "negatives-buckets")
    blocks = stored(packed(rows.filter(anchors), per_block, 1).withColumn("block", F.col("grp")), "negatives-blocks")
    found = search(buckets, blocks.withColumn("windows", F.lit(None).cast(WINDOWS)).withColumn("limit", F.lit(NONE)), k_positives)
    positives = stored(first(found, k_positives, "block", "anchor").select("block", "anchor", (F.col("row") - 1).cast("int").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    wide = lambda per: F.col("positive_score").cast("decimal(25,0)") * per / F.lit(100)
    windows = positives.filter("positive_score >= 0").withColumn("least", F.ceil(wide(low)).cast("long")).withColumn("most", F.floor(wide(high)).cast("long"))
    windows = windows.groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "least", "most")).alias("windows"), F.min("least").alias("limit"))
    windows = stored(blocks.join(windows, "block"), "negatives-windows")
    negatives = first(search(buckets, windows, k_negatives), k_negatives, "block", "anchor", "place")
    ids = in_batches(blocks.select("block", "ids"), _anchor_ids, "block long, anchor int, anchor_id long")
    named = positives.join(ids, ["block", "anchor"])
    made = negatives.select("block", "anchor", "place", F.col("row").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["block", "anchor", "place"])
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "anchor", "anchor_id"])


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
             list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::HUGEINT::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, place FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.r, anchor_id, positive_id, positive_score, place, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, place ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
