"""Windows of beats as bytes. Tables that are stored or shuffled hold pieces, a row for all beats of a chunk, in which a window of 75 values takes
about 90 bytes instead of 300 as floats or 600 as doubles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A chunk's beats by k, how many of them have a window (n), and the windows packed. k goes up with t_ms, so that chunks follow one another.
PIECES = "record_id long, chunk int, n int, k array<long>, t_ms array<long>, label array<string>, window binary"

HEAD = struct.Struct("<IIf")  # rows, width, unit (0: the values are floats)


def packed(windows: pa.ListArray, unit: float = 0.0) -> bytes:
    """Lists of float32 of one width, or null, without loss: where all values are whole multiples of unit, as 16-bit numbers of units."""
    has = windows.is_valid().to_numpy(zero_copy_only=False)
    x = windows.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    unit, body = np.float32(unit), x
    if unit:
        with np.errstate(all="ignore"):
            units = np.rint(x / unit)
            whole = units.astype(np.int16)
        body = whole if (np.abs(units) < 2**15).all() and (whole * unit).tobytes() == x.tobytes() else x
    kept = HEAD.pack(len(has), len(x) // max(1, int(has.sum())), unit if body is not x else 0)
    return kept + np.packbits(has).tobytes() + pa.compress(body.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a window, and these windows (float32)."""
    rows, width, unit = HEAD.unpack_from(raw)
    begin = HEAD.size + (rows + 7) // 8
    has = np.unpackbits(np.frombuffer(raw, np.uint8, begin - HEAD.size, HEAD.size), count=rows).astype(bool)
    kind = np.dtype(np.int16 if unit else np.float32)
    x = np.frombuffer(pa.decompress(raw[begin:], int(has.sum()) * width * kind.itemsize, codec="zstd", asbytes=True), kind).reshape(-1, width) if width else np.empty((0, 0), np.float32)
    return has, x * np.float32(unit) if unit else x


def in_rows(pieces: DataFrame) -> DataFrame:
    """(record_id, k, t_ms, label, window) of pieces, a row per beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for record, k, t_ms, label, raw in zip(b.column("record_id"), *(b.column(c) for c in ("k", "t_ms", "label")), b.column("window"), strict=True):
                has, x = unpacked(raw.as_py())
                ends = pa.array(np.concatenate([[0], np.cumsum(has)]) * x.shape[1], pa.int32())
                windows = pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float64)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([pa.repeat(record, len(has)), k.values, t_ms.values, label.values, windows], names=["record_id", "k", "t_ms", "label", "window"])

    return pieces.select("record_id", "k", "t_ms", "label", "window").mapInArrow(run, "record_id long, k long, t_ms long, label string, window array<double>")
