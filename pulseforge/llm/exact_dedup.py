"""Exact deduplication with counting quotient filters.

A filter per partition and shard of the fingerprint space; filters of a shard merge losslessly by sorted remainders.
Fingerprints counted more than once route their rows to byte verification, all other rows are unique.

Null text counts as empty. Texts are equal when identical after each run of ASCII white space becomes one space. Rows with
equal texts form a group; the smallest doc_id (null last) stays. Rows that repeat a doc_id are rows of their own: those with
the keeping doc_id in one group all say kept. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_batches, stored

#: Bits of a quotient; a fingerprint's other bits are its shard (high) and remainder (low).
QUOTIENT_BITS = 16
#: Fingerprints aimed at in the merged filter of one shard, and most that a partition gathers before it builds its filters.
SHARD_ROWS = 250_000
FILTER_ROWS = 4_000_000


class QuotientFilter:
    """A counting quotient filter without empty slots.

    A fingerprint's high bits are its quotient, which has a bit in `occupied`; its low bits are its remainder. The
    remainders of a quotient form a sorted run, whose last slot has a bit in `runends`; `counts` has how often each came.
    """

    def __init__(self, remainder_bits: int, occupied: np.ndarray, runends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.remainder_bits, self.occupied, self.runends, self.remainders, self.counts = remainder_bits, occupied, runends, remainders, counts

    @classmethod
    def build(cls, low: np.ndarray, counts: np.ndarray, remainder_bits: int) -> QuotientFilter:
        """low: fingerprints of QUOTIENT_BITS and remainder_bits bits, sorted and distinct."""
        quotients = (low >> np.uint64(remainder_bits)).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotients] = True
        runends = np.ones(len(low), bool)
        runends[:-1] = quotients[1:] != quotients[:-1]
        return cls(remainder_bits, occupied, runends, low & np.uint64((1 << remainder_bits) - 1), counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        lengths = np.diff(np.r_[-1, np.flatnonzero(self.runends)])
        quotients = np.repeat(np.flatnonzero(self.occupied).astype(np.uint64), lengths)
        return (quotients << np.uint64(self.remainder_bits)) | self.remainders, self.counts

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the sum of the counts; nothing is lost, as equal quotients and remainders are equal fingerprints."""
        items = [f.items() for f in filters]
        low, counts = np.concatenate([x[0] for x in items]), np.concatenate([x[1] for x in items])
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.diff(low, prepend=low[:1] ^ np.uint64(1)))
        return cls.build(low[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].remainder_bits)

    def to_bytes(self) -> bytes:
        """Occupied quotients as a bitmap, or as a list where that is shorter; counts only where they are above one."""
        many, quotients = np.flatnonzero(self.counts > 1), np.flatnonzero(self.occupied).astype("<u2")
        listed = quotients.nbytes < len(self.occupied) // 8
        head = np.array([self.remainder_bits, len(self.remainders), len(many), len(quotients) if listed else -1], "<i8")
        wide = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-self.remainder_bits // 8)]
        body = quotients if listed else np.packbits(self.occupied)
        return b"".join(x.tobytes() for x in (head, body, np.packbits(self.runends), wide, many.astype("<i4"), self.counts[many].astype("<i8")))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        bits, n, many, listed = np.frombuffer(blob, "<i8", 4).tolist()
        at, width = 32, -(-bits // 8)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        if listed < 0:
            occupied = np.unpackbits(take("u1", (1 << QUOTIENT_BITS) // 8)).astype(bool)
        else:
            occupied = np.zeros(1 << QUOTIENT_BITS, bool)
            occupied[take("<u2", listed)] = True
        runends = np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take("u1", n * width).reshape(n, width)
        counts = np.ones(n, np.int64)
        where = take("<i4", many)
        counts[where] = take("<i8", many)
        return cls(bits, occupied, runends, wide.view("<u8").ravel(), counts)


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints (column fp) that occur more than once among rows rows."""
    shard_bits = max(2, int(np.ceil(np.log2(max(1, rows / SHARD_ROWS)))))
    below = np.uint64(64 - shard_bits)
    remainder_bits = 64 - shard_bits - QUOTIENT_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def filters() -> pa.RecordBatch:
            fp, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            held.clear()
            shard = (fp >> below).astype(np.int64)
            at = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1))
            low = fp & np.uint64((1 << int(below)) - 1)
            made = [QuotientFilter.build(low[a:b], counts[a:b], remainder_bits).to_bytes() for a, b in zip(at, np.r_[at[1:], len(fp)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int64()), pa.array(made, pa.binary())], names=["shard", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield filters()
        if held:
            yield filters()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = QuotientFilter.merge([QuotientFilter.from_bytes(b) for b in frame["filter"]])
        low, counts = whole.items()
        again = counts > 1
        fp = low[again] | (np.uint64(int(frame["shard"].iloc[0])) << below)
        return pd.DataFrame({"fp": fp.view(np.int64), "n": counts[again]})

    return in_batches(fps.select("fp"), build, "shard long, filter binary").groupBy("shard").applyInPandas(merge, "fp long, n long")


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, fingerprint (xxhash64 of the normalised text)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    hashed = stored(texts.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-fingerprints")
    again = stored(repeated_fingerprints(hashed, hashed.count()), "dedup-repeated").select("fp")
    small = again.count() <= BROADCAST_ROWS
    again = F.broadcast(again) if small else again
    # Byte verification: rows of a repeated fingerprint group by their very text, summed before the shuffle.
    suspects = texts.withColumn("fp", F.xxhash64("norm")).join(again, "fp", "left_semi")
    groups = suspects.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.filter("group_size > 1").select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "dedup-groups")
    found = hashed.join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("fp").alias("fingerprint"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) that stay; of rows that repeat a doc_id and its text, one."""
    made = stored(exact_dedup(docs), "dedup-rows")
    gone = made.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp")).distinct()
    gone = F.broadcast(gone) if made.filter("not kept").count() <= BROADCAST_ROWS else gone
    stay = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(normalised()) == F.col("_fp")), "left_anti")
    twice = made.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count()
    if not twice:
        return stay
    keyed = stay.withColumn("_norm", F.xxhash64(normalised()))
    return keyed.dropDuplicates(["doc_id", "_norm"]).drop("_norm")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
