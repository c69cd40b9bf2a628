"""Files of records, written by the executors: EDF+, NPY, CSV and SVG, one of each record, streamed from its chunks.

The data source `holter_files` takes rows of chunks in the order that its format needs (export_files sees to it): a task holds a
chunk of all leads at most (NPY: of one), whatever a record's length. Tasks write under _temporary; once all are done, their
files move to their names, so that a file that is there is whole, and tasks that are lost or run twice leave none.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .exports import edf_head, strip
from .scp import Record, opened, window

META = ("fs", "avm_nv", "n_samples", "leads", "patient")


class Encoder:
    """What of a record's file each of its rows adds: rows come by chunk, then lead, or (by_lead) the other way round."""

    by_lead = False

    def __init__(self, record: Record, options: dict):
        self.record, self.options = record, options
        start, dur = float(options.get("start_s", 0)), options.get("dur_s")
        self.a, self.b = window(record, start, None if dur is None else float(dur))
        self.sign = -1 if options.get("invert") == "true" else 1
        self.mv = np.float32(self.sign * record.avm_nv / 1e6)
        self.held: list[np.ndarray] = []

    def head(self) -> bytes:
        return b""

    def row(self, lead: int, x: np.ndarray) -> bytes:
        """x: the row's samples in the window."""
        self.held.append(x)
        if len(self.held) < len(self.record.leads):
            return b""
        block, self.held = np.stack(self.held), []
        return self.block(block)

    def block(self, x: np.ndarray) -> bytes:
        """x: leads by samples, the next of the window."""
        raise NotImplementedError

    def tail(self) -> bytes:
        return b""


class Edf(Encoder):
    def __init__(self, record: Record, options: dict):
        super().__init__(record, options)
        self.fs = round(record.fs)
        if abs(self.fs - record.fs) > 1e-9:
            raise ValueError(f"EDF needs a whole number of samples a second, not {record.fs}")
        self.left = np.empty((len(record.leads), 0), "<i2")

    def head(self) -> bytes:
        return edf_head(self.record, (self.b - self.a) // self.fs, self.fs)

    def block(self, x: np.ndarray) -> bytes:
        """Whole seconds; what is left of one goes before the next block, and in the end is left out."""
        x = np.concatenate([self.left, x], axis=1)
        whole = x.shape[1] // self.fs
        x, self.left = x[:, : whole * self.fs], x[:, whole * self.fs :]
        x = x.reshape(len(x), whole, self.fs).transpose(1, 0, 2)
        return (np.clip(-x.astype(np.int32), -32768, 32767) if self.sign < 0 else x).astype("<i2").tobytes()


class Npy(Encoder):
    by_lead = True

    def head(self) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (len(self.record.leads), self.b - self.a)})
        return out.getvalue()

    def row(self, lead: int, x: np.ndarray) -> bytes:
        return (x.astype(np.float32) * self.mv).tobytes()


class Csv(Encoder):
    def __init__(self, record: Record, options: dict):
        super().__init__(record, options)
        self.at = self.a

    def head(self) -> bytes:
        return (",".join(["t_s", *self.record.leads]) + "\n").encode()

    def block(self, x: np.ndarray) -> bytes:
        out = io.BytesIO()
        for a in range(0, x.shape[1], 10_000):
            part = x[:, a : a + 10_000]
            t = (self.at + a + np.arange(part.shape[1])) / self.record.fs
            np.savetxt(out, np.c_[t, part.T.astype(np.float32) * float(self.mv)], "%.4f", ",")
        self.at += x.shape[1]
        return out.getvalue()


class Svg(Encoder):
    """A strip of up to two minutes is held whole."""

    def __init__(self, record: Record, options: dict):
        super().__init__(record, options)
        self.parts: list[np.ndarray] = []
        if self.b - self.a > 120 * record.fs:
            raise ValueError("a strip has up to 120 s")

    def block(self, x: np.ndarray) -> bytes:
        self.parts.append(x)
        return b""

    def tail(self) -> bytes:
        names = self.options["leads"].split(",") if self.options.get("leads") else self.record.leads
        x = np.concatenate(self.parts, axis=1)[[self.record.leads.index(n) for n in names]]
        return strip(x.astype(np.float32) * self.mv, names, self.record.fs, float(self.options.get("start_s", 0)), float(self.options.get("dur_s", 10))).encode()


ENCODERS = {"edf": Edf, "npy": Npy, "csv": Csv, "svg": Svg}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: where each file is, and where it belongs


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, kind: str, options: dict):
        self.uri, self.kind, self.options = uri, kind, options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.uri)
        made, name, out, encoder = [], None, None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if row["record_id"] != name:
                    if out is not None:
                        out.write(encoder.tail())
                        out.close()
                    name = row["record_id"]
                    leads = row["leads"]
                    record = Record({k: v for k, v in (row["patient"] or {}).items() if v is not None}, leads, 0, row["avm_nv"], round(1e6 / row["fs"]), 0, row["n_samples"])
                    encoder = ENCODERS[self.kind](record, self.options)
                    temporary = f"{folder}/_temporary/{uuid.uuid4().hex}"
                    store.create_dir(f"{folder}/_temporary")
                    out = store.open_output_stream(temporary)
                    made.append((temporary, f"{folder}/{name}.{self.kind}"))
                    out.write(encoder.head())
                x, first = np.array(row["samples"], "<i2"), row["sample0"]
                out.write(encoder.row(row["lead"], x[max(0, encoder.a - first) : max(0, encoder.b - first)]))
        if out is not None:
            out.write(encoder.tail())
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.uri)
        for m in messages:
            for made, name in m.files if m else []:
                store.move(made, name)
        store.delete_dir_contents(f"{folder}/_temporary", missing_dir_ok=True)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.uri)
        store.delete_dir_contents(f"{folder}/_temporary", missing_dir_ok=True)


class HolterFiles(DataSource):
    """df.write.format("holter_files").option("kind", ...); see export_files."""

    @classmethod
    def name(cls) -> str:
        return "holter_files"

    def writer(self, schema, overwrite: bool):
        options = {k: v for k, v in self.options.items() if k != "path"}
        kind = options.pop("kind", "")
        if kind not in ENCODERS:
            raise ValueError(f"kind must be one of {sorted(ENCODERS)}")
        return _Writer(self.options["path"], kind, options)


def export_files(signal: DataFrame, records: DataFrame, path: str, kind: str, start_s: float = 0, dur_s: float | None = None, invert: bool = False, leads: list[str] | None = None) -> None:
    """A file per record of signal (record_id, lead, chunk, sample0, samples; all leads) in the folder path. records: as read_records gives
    them. Only the chunks that the window touches are read; a lead's whole samples are never in one place but for a strip's."""
    signal.sparkSession.dataSource.register(HolterFiles)
    meta = records.select("record_id", *META)
    rate = F.col("fs")
    a = F.round(F.lit(float(start_s)) * rate).cast("long")
    last = F.col("n_samples") if dur_s is None else F.least(F.col("n_samples"), a + F.round(F.lit(float(dur_s)) * rate).cast("long"))
    rows = signal.join(meta, "record_id").filter((F.col("sample0") < last) & (F.col("sample0") + F.size("samples") > a))
    order = ["lead", "chunk"] if ENCODERS[kind].by_lead else ["chunk", "lead"]
    writer = rows.repartition("record_id").sortWithinPartitions("record_id", *order).write.format("holter_files").mode("append").option("kind", kind).option("start_s", start_s).option("invert", invert)
    if dur_s is not None:
        writer = writer.option("dur_s", dur_s)
    if leads:
        writer = writer.option("leads", ",".join(leads))
    writer.save(path)
