"""Mixing sources to target weights.

Each source's words, in the order of its documents, are packed into blocks of a fixed length. An output shard draws how many
of its slots go to each source: the whole parts of their expected counts, and a multinomial draw for the rest. The slots of a
source, numbered over all shards, map through a pseudorandom permutation of its block numbers, epoch by epoch, and slots meet
blocks in a join by number. No block is taken more than max_epochs times: slots drawn for a source beyond that go, in one more
shard, to the sources that are furthest below their targets and have blocks left.

Sources weigh by rank in code point order, null last. Null text has size 0; documents of size 0 are never taken. Rows that
repeat a doc_id are rows of their own. An empty table gives an empty mix; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, running_sums, stored, utf8

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_SLOTS = 65_536


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, plus size: words between runs of ASCII white space."""
    others = [c for c in docs.columns if c != text_col]

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        size = pa.array([0 if t is None else len(t.split()) for t in utf8(b.column(b.num_columns - 1))], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], size], names=[*others, "size"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(others).dtypes), "size long"])
    return map_arrow(docs.select(*others, text_col), step, schema)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, weight, source_size, target) of sizes(source, size): one row per source.

    Targets share share * all words by weight; none is above most * its source's size. Filling to one common level per unit
    of weight: with sources in the order of cap / weight, those before some place stand at their caps, the rest at the level.
    The windows below run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # The first place in the order whose level its own cap allows; levels fall from there on, so it has the largest.
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_rows)
    ranked = ranked.withColumn("final", level)
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "rank", "weight", "source_size", target.alias("target"))


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, at index: a Feistel network over the next even number of bits, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_draws(spark: SparkSession, targets: list[tuple[int, float]], block_words: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, rank, drawn): the slots of each shard by source. targets: rank and words of each source."""
    words = np.array([t for _, t in targets], float)
    ranks = np.array([r for r, _ in targets], np.int64)
    slots = int(np.ceil(words.sum() / block_words)) if len(words) else 0
    shards = -(-slots // shard_slots)
    share = words / max(words.sum(), 1e-300)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for shard in frame["id"]:
                # equal shards but for rounding
                size = (shard + 1) * slots // shards - shard * slots // shards
                expected = share * size
                whole = np.floor(expected + 1e-9)
                rest = np.maximum(expected - whole, 0)
                left = int(size - whole.sum())
                drawn = whole.astype(np.int64)
                if left > 0:
                    odds = rest / rest.sum() if rest.sum() > 0 else share
                    drawn += np.random.default_rng(seed_of(seed, int(shard))).multinomial(left, odds)
                yield pd.DataFrame({"shard": int(shard), "rank": ranks, "drawn": drawn})

    return spark.range(shards).mapInPandas(draw, "shard long, rank int, drawn long")


def with_room(draws: DataFrame, targets: list[tuple[int, float, int]], block_words: int, max_epochs: int) -> DataFrame:
    """draws and one more shard: as many slots as draws has beyond max_epochs times the blocks of their sources, for sources that have room.

    targets: rank, words and blocks of each source. One row per source reaches the driver.
    """
    drawn = {r["rank"]: int(r["drawn"]) for r in draws.groupBy("rank").agg(F.sum("drawn").alias("drawn")).collect()}
    got = np.array([drawn.get(r, 0) for r, _, _ in targets], np.int64)
    room = np.array([max_epochs * b for _, _, b in targets], np.int64) - got
    again = int(np.maximum(-room, 0).sum())
    if not again:
        return draws
    want = np.array([w / block_words for _, w, _ in targets]) - got
    extra, left = np.zeros(len(got), np.int64), again
    for k in np.argsort(-want, kind="stable"):  # first what their targets lack, then whatever has room
        extra[k] = min(max(0, round(want[k])), max(0, room[k]), left)
        left -= extra[k]
    for k in np.argsort(-want, kind="stable"):
        more = min(max(0, room[k] - extra[k]), left)
        extra[k] += more
        left -= more
    if not extra.any():
        return draws
    # An Arrow table goes to the JVM as it is; rows would start a second set of Python workers, which stay beside the first.
    rows = pa.table({"rank": pa.array([r for r, _, _ in targets], pa.int32()), "drawn": pa.array(extra)}).filter(pa.array(extra > 0))
    last = draws.agg((F.max("shard") + 1).alias("shard"))  # one row
    added = draws.sparkSession.createDataFrame(rows, "rank int, drawn long").crossJoin(F.broadcast(last))
    return draws.unionByName(added.select("shard", "rank", "drawn"))


def mixed_slots(draws: DataFrame, blocks: DataFrame, seed: int, max_epochs: int = 2) -> DataFrame:
    """(shard, slot, rank, block): each slot's block. blocks: (rank, blocks) with how many each source has."""
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = draws.withColumn("first", F.coalesce(F.sum("drawn").over(earlier), F.lit(0))).join(F.broadcast(blocks), "rank")
    # What is cut off here has been drawn again by with_room.
    room = F.col("blocks") * max_epochs - F.col("first")
    numbered = numbered.withColumn("drawn", F.least("drawn", room)).filter("drawn > 0")
    # Pieces of at most 4096 slots, dealt to a set number of tasks: the few rows before they unfold would else go to one.
    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = numbered.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("drawn") - 1, F.lit(4096)))).repartition(tasks, "shard", "rank", "at")
    slots = pieces.withColumn("slot", F.explode(F.sequence("at", F.least(F.col("at") + 4095, F.col("drawn") - 1))))

    # Not a column's function: what filters its column (a join does, for nulls) would call it once more in the same task.
    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        rank, number, size = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 5))
        kinds, where = np.unique(np.stack([rank, number // size]), axis=1, return_inverse=True)
        keys = np.array([seed_of(seed, int(r), int(e)) for r, e in kinds.T], np.uint64)
        block = permuted(number % size, size, keys[where.ravel()])
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(block)], names=["shard", "slot", "rank", "block"])

    return map_arrow(slots.select("shard", "slot", "rank", (F.col("first") + F.col("slot")).alias("number"), "blocks"), placed, "shard long, slot long, rank int, block long")


class Mix:
    """What mix() makes. rows: the documents' rows with place (part, pos), size and source_size, target; blocks: (rank, block,
    part, pos, words, word0), a document's words in a block; slots: (shard, slot, rank, block)."""

    def __init__(self, rows: DataFrame, blocks: DataFrame, slots: DataFrame):
        self.rows, self.blocks, self.slots = rows, blocks, slots

    def pieces(self) -> DataFrame:
        """The mix itself: (shard, slot, part, pos, word0, words), the words of each slot."""
        return self.slots.join(self.blocks.hint("merge"), ["rank", "block"])

    def taken(self) -> DataFrame:
        """(part, pos, word0, words, times): how often the mix takes each piece of a document."""
        times = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
        # Numbers compress so well that their shuffled size would suggest a broadcast.
        return times.join(self.blocks.hint("merge"), ["rank", "block"]).select("part", "pos", "word0", "words", "times")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS, seed: int = 17) -> Mix:
    spark = docs.sparkSession
    sized = stored(word_counts(docs.select("doc_id", "source", *[c for c in ("key", "key2") if c in docs.columns], "text")), "mix-sizes")
    targets = stored(source_targets(sized, share, max_epochs, weights), "mix-targets")
    rows = stored(running_sums(sized, "source", ["doc_id", "size"], "size", "mix-order"), "mix-rows")
    blocks = targets.select("rank", "target", F.ceil(F.col("source_size") / block_words).alias("blocks")).filter("blocks > 0")
    # One row per source reaches the driver, and each task that draws.
    known = [(int(r["rank"]), float(r["target"]), int(r["blocks"])) for r in blocks.filter("target > 0").orderBy("rank").collect()]
    draws = stored(shard_draws(spark, [k[:2] for k in known], block_words, seed), "mix-draws")
    slots = mixed_slots(with_room(draws, known, block_words, max_epochs), blocks.select("rank", "blocks"), seed, max_epochs)
    named = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    placed = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    first, last = F.expr(f"before div {block_words}"), F.expr(f"(before + size - 1) div {block_words}")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block_words, F.col("before"))
    end = F.least((F.col("block") + 1) * block_words, F.col("before") + F.col("size"))
    pieces = cut.select("rank", "block", "part", "pos", (end - start).alias("words"), (start - F.col("before")).alias("word0"))
    return Mix(placed, pieces, slots)


def mix_summary(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    made = mix(docs)
    taken = made.taken().groupBy("part", "pos").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return made.rows.join(taken, ["part", "pos"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(((raw == 32) | (raw >= 9) & (raw <= 13)).astype(np.int8), prepend=1, append=1))
    return edge[::2], edge[1::2]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix seen by document, in the columns of documents: row c of a document (c = 1, 2) has, in order, the words that the
    mix takes at least c times, each run of words with the white space inside it and runs apart by a line feed; a whole text
    stays as it is. Rows that are equal in all columns are mixed each on its own; rows are known by 128 bits of hash."""
    columns = ["doc_id", "text", "lang", "source"]
    keyed = docs.select(*columns, F.xxhash64(*columns).alias("key"), F.xxhash64(F.lit("second"), *columns).alias("key2"))
    made = mix(keyed)
    spans = made.taken().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    spans = spans.groupBy("part", "pos", "copy").agg(F.sort_array(F.collect_list(F.struct("word0", "words"))).alias("spans"))
    spans = made.rows.select("part", "pos", "key", "key2", "size").join(spans, ["part", "pos"]).select("key", "key2", "size", "spans")
    held = keyed.dropDuplicates(["key", "key2"]).join(spans, ["key", "key2"]).select("doc_id", "text", "lang", "source", "size", "spans")

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, size, spans in zip(utf8(b.column(1)), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            if sum(s["words"] for s in spans) == size:
                out.append(text.decode())
                continue
            starts, ends = word_bounds(text)
            first = np.array([s["word0"] for s in spans])
            last = first + np.array([s["words"] for s in spans])
            new = np.r_[True, first[1:] != last[:-1]]
            runs = zip(starts[first[new]].tolist(), ends[last[np.r_[new[1:], True]] - 1].tolist(), strict=True)
            out.append(b"\n".join(text[a:b] for a, b in runs).decode())
        text = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), text, b.column(2), b.column(3), pa.array([len(x) for x in out], pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    return map_arrow(held, step, "doc_id long, text string, lang string, source string, n_chars long")
