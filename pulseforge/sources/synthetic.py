"""A 12-lead signal made of given beats: a QRS and a T wave at each beat, wide and inverted for V, with noise by seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signal import Source, chunk_length

#: Height of the QRS by lead, in mV
HEIGHT = (0.8, 1.2, 0.5, -0.9, 0.3, 0.8, 0.4, 1.1, 1.5, 1.3, 1.0, 0.7)

#: How far beyond a chunk its row knows beats: readers' halos are shorter
BESIDE_MS = 5000


def source_of(beats: DataFrame, fs: int = 125, mv: float = 0.001747, seed: int = 1) -> Source:
    """The signal up to a second past the last of beats (record_id, k, t_ms, label), drawn by the tasks that need it. A chunk's row
    holds its beats; its noise depends on record, lead and chunk alone."""
    length = chunk_length(fs)
    chunk_ms = length * 1000 // fs
    span = beats.groupBy("record_id").agg(F.expr(f"(max(t_ms) + 1000) * {fs} div 1000").alias("n_samples"), F.expr(f"sequence(0, cast((max(t_ms) + 1000) div {chunk_ms} as int))").alias("chunks"))
    frame = span.select("record_id", "n_samples", F.explode("chunks").alias("chunk"))
    near = beats.select("record_id", "t_ms", (F.col("label") == "V").alias("wide"), F.explode(F.expr(f"sequence(cast(greatest(0, t_ms - {BESIDE_MS}) div {chunk_ms} as int), cast((t_ms + {BESIDE_MS}) div {chunk_ms} as int))")).alias("chunk"))
    held = near.groupBy("record_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t_ms", F.coalesce("wide", F.lit(False)).alias("wide")))).alias("own"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    chunks = frame.join(held, ["record_id", "chunk"], "left").select(
        "record_id", "chunk", (F.col("chunk").cast("long") * length).alias("sample0"), F.greatest(F.lit(0), F.least(F.lit(length), F.col("n_samples") - F.col("chunk").cast("long") * length)).cast("int").alias("size"), "n_samples",
        none(F.col("own.t_ms"), "bigint").alias("t_ms"), none(F.col("own.wide"), "boolean").alias("wide"),
    )
    reach = np.arange(-fs // 2, fs // 2 + 1)

    def drawn(row: dict, leads: tuple[int, ...], chunk: int, a: int, b: int) -> np.ndarray:
        """Samples [a, b) of a chunk, counted from its first: leads by samples. The leads' waves are one, but for their heights."""
        at = np.asarray(row["t_ms"], np.int64) * fs / 1000 - chunk * length
        near = np.flatnonzero((at > a - fs) & (at < b + fs))
        at, wide = at[near], np.asarray(row["wide"], bool)[near]
        first = at.astype(np.int64)
        i = first[:, None] + reach
        # A beat's wave depends on its kind and on where it lies between two samples alone, which is at one of few places.
        places, place = np.unique(at - first, return_inverse=True)
        s = (reach - places[:, None]) / fs
        qrs = [sign * np.exp(-0.5 * (s / width) ** 2) for width, sign in ((0.016, 1.0), (0.028, -1.2))]
        waves = (np.stack(qrs) + 0.25 * np.exp(-0.5 * ((s - 0.28) / 0.05) ** 2))[wide.astype(int), place]
        inside = (i >= a) & (i < b)
        wave = np.bincount(i[inside] - a, waves[inside], b - a)
        out = np.empty((len(leads), b - a), np.int16)
        for held, lead in zip(out, leads, strict=True):
            noise = np.random.default_rng([seed, row["record_id"], lead, chunk]).normal(0, 0.012, b)[a:]
            held[:] = np.rint((wave * HEIGHT[lead] + noise) / mv)
        return out

    def read(row: dict, leads: tuple[int, ...], a: int, b: int) -> np.ndarray:
        parts = [drawn(row, leads, c, max(0, a - c * length), min(length, b - c * length)) for c in range(a // length, (b - 1) // length + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty((len(leads), 0), np.int16)], axis=1)

    return Source(chunks, read)


def signal_of(beats: DataFrame, fs: int = 125, mv: float = 0.001747, seed: int = 1, leads: tuple[int, ...] = tuple(range(len(HEIGHT))), chunks: tuple[int, int] | None = None) -> DataFrame:
    """The same as rows (record_id, lead, chunk, sample0, samples), of some leads and of the chunks from the first to the last of two, where only those are read."""
    return source_of(beats, fs, mv, seed).rows(leads, chunks)
