"""Exports: CSV rows, NPY, EDF+ and SVG files as bytes, JSON of a whole record, a keyed cache of what edits do not touch.

The functions that take a path read one local file; sources.files writes the same bytes for any number of records, from chunks."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edf_date, transliterate
from ..operators.store import checkpointed
from .scp import LIMB, Record, read_lead, read_mv, window


def csv_rows(signal: DataFrame, leads: list[str], fs: float, mv: float) -> DataFrame:
    """(record_id, t_s, a column per lead), text with four decimals, of signal rows; write with .csv(header=True)."""
    points = signal.select("record_id", "lead", F.posexplode("samples").alias("p", "x"), "sample0")
    wide = points.groupBy("record_id", (F.col("sample0") + F.col("p")).alias("i")).pivot("lead", list(range(len(leads)))).agg(F.first("x"))
    shown = [F.format_string("%.4f", F.col(str(k)).cast("float") * F.lit(mv)).alias(name) for k, name in enumerate(leads)]
    return wide.orderBy("record_id", "i").select("record_id", F.format_string("%.4f", F.col("i") / F.lit(float(fs))).alias("t_s"), *shown)


def npy_bytes(path: str, record: Record, start_s: float = 0, dur_s: float | None = None) -> bytes:
    out = io.BytesIO()
    np.save(out, read_mv(path, record, start_s, dur_s))
    return out.getvalue()


#: What recorded the signal, and the leads, as the header names them
RECORDER, LIMB_LEAD, CHEST_LEAD = "Holter_ECG", "Holter limb lead", "Holter chest lead, position not verified"


def edf_head(record: Record, seconds: int, fs: int) -> bytes:
    """Header of EDF+C with one-second records. Widths and texts are fixed values of the format; signal fields lie field by field."""
    n, card, lsb = len(record.leads), record.patient, record.avm_nv / 1e6
    name = transliterate("_".join(card.get(part, "") for part in ("first_name", "last_name"))).strip("_ ").replace(" ", "_")
    began = f"{card.get('acq_date') or '1985-01-01'}T{card.get('acq_time') or '00:00:00'}"
    year, month, day = began[:10].split("-")
    text = {
        "version": (8, "0"),
        "patient": (80, " ".join((str(card.get("patient_id", "X")), str(card.get("sex", "X")), edf_date(card.get("dob")), name or "X"))),
        "recording": (80, f"Startdate {edf_date(card.get('acq_date'), '01-JAN-1985')} X X {RECORDER}"),
        "date": (8, f"{day}.{month}.{year[2:]}"),
        "time": (8, began[11:].replace(":", ".")),
        "bytes": (8, str(256 * (n + 1))),
        "kind": (44, "EDF+C"),
        "records": (8, str(seconds)),
        "length": (8, "1"),
        "signals": (4, str(n)),
    }
    signals = {
        "label": (16, record.leads),
        "transducer": (80, [LIMB_LEAD if i < len(LIMB) else CHEST_LEAD for i in range(n)]),
        "unit": (8, ["mV"] * n),
        "least": (8, [f"{-32768 * lsb:.4f}"] * n),
        "most": (8, [f"{32767 * lsb:.4f}"] * n),
        "digital_least": (8, ["-32768"] * n),
        "digital_most": (8, ["32767"] * n),
        "filter": (80, ["HP:0.05Hz"] * n),
        "rate": (8, [str(fs)] * n),
        "spare": (32, [""] * n),
    }
    head = np.zeros((), [(k, f"S{w}") for k, (w, _) in text.items()] + [(k, f"S{w}", (n,)) for k, (w, _) in signals.items()])
    for field, (_, value) in (text | signals).items():
        head[field] = np.char.encode(np.array(value, str), "ascii", "replace")
    return head.tobytes().replace(b"\0", b" ")


def edf_bytes(path: str, record: Record, start_s: float = 0, dur_s: float | None = None, invert: bool = False) -> bytes:
    """EDF+C with records of one second; the partial last second is left out."""
    fs = round(record.fs)
    if abs(fs - record.fs) > 1e-9:
        raise ValueError(f"EDF needs a whole number of samples a second, not {record.fs}")
    a, b = window(record, start_s, dur_s)
    seconds = (b - a) // fs
    x = np.stack([read_lead(path, record, c, a, a + seconds * fs).reshape(seconds, fs) for c in range(len(record.leads))], axis=1)
    if invert:
        x = np.clip(-x.astype(np.int32), -32768, 32767)
    return edf_head(record, seconds, fs) + x.astype("<i2").tobytes()


def svg_text(path: str, record: Record, start_s: float = 0, dur_s: float = 10, leads: list[str] | None = None, mm_s: float = 25, mm_mv: float | None = None, px: float = 3.0, row_mm: float = 20) -> str:
    """A strip on millimetre paper in user units of a millimetre: a lane per lead around its median, all at one gain that fits them."""
    pick = [record.leads.index(name) for name in leads or record.leads]
    return strip(read_mv(path, record, start_s, dur_s)[pick], [record.leads[c] for c in pick], record.fs, start_s, dur_s, mm_s, mm_mv, px, row_mm)


def strip(x: np.ndarray, names: list[str], fs: float, start_s: float = 0, dur_s: float = 10, mm_s: float = 25, mm_mv: float | None = None, px: float = 3.0, row_mm: float = 20) -> str:
    """The strip of samples x in mV, leads by samples."""
    x = x - np.median(x, axis=1, keepdims=True)
    gain = mm_mv or 0.45 * row_mm / max(float(np.abs(x).max(initial=0)), 1e-3)
    width, height = dur_s * mm_s, row_mm * len(names)
    at = np.arange(x.shape[1]) / fs * mm_s
    lanes = []
    for row, (name, y) in enumerate(zip(names, x, strict=True)):
        dots = " ".join(map("{:.2f},{:.2f}".format, at, row_mm * (row + 0.5) - y * gain))
        lanes.append(f'<polyline class="trace" points="{dots}"/><text x="1" y="{row_mm * row + 4:g}">{name}</text>')
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width * px:.0f}" height="{(height + 6) * px:.0f}" viewBox="0 0 {width:g} {height + 6:g}">'
        "<style>.paper{stroke:#d8e4ec;stroke-width:.1;fill:none}.trace{stroke:#234;stroke-width:.3;fill:none}text{font:3px sans-serif}</style>"
        '<defs><pattern id="mm" width="5" height="5" patternUnits="userSpaceOnUse"><path class="paper" d="M1 0V5M2 0V5M3 0V5M4 0V5M0 1H5M0 2H5M0 3H5M0 4H5"/><path class="paper" style="stroke-width:.3" d="M0 0H5V5"/></pattern></defs>'
        f'<rect width="{width:g}" height="{height:g}" fill="url(#mm)"/>{"".join(lanes)}'
        f'<text x="1" y="{height + 4:g}">from {start_s:g} s for {dur_s:g} s, {mm_s:g} mm/s, {gain:.3g} mm/mV</text></svg>'
    )


def export_json(beats: DataFrame, episodes: DataFrame, counts: DataFrame, criteria: DataFrame, one: dict[str, DataFrame] | None = None, many: dict[str, DataFrame] | None = None) -> DataFrame:
    """(record_id, json): every beat with its label and the device's, episodes in order, verdict counts, criteria.

    one: further tables of at most a row per record (the record, its patient, rates), objects under their names.
    many: tables of any number of rows (diary, edits), arrays in the order of their columns, empty where a record has none.
    """
    lists = {
        "beats": beats.select("record_id", "t_ms", "label", "device_label"),
        "episodes": episodes.select("record_id", "id", "kind", "t_ms", "dur_ms", "verdict", "confidence", "title"),
        "verdicts": counts.select("record_id", "label", "verdict", "n"),
        "criteria": criteria.select("record_id", "key", "met", "value"),
    } | (many or {})
    parts = {}
    for name, df in lists.items():
        parts[name] = df.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "record_id"]))).alias(name))
    out = parts.pop("beats")
    for name, df in (one or {}).items():
        out = out.join(df.select("record_id", F.struct(*[c for c in df.columns if c != "record_id"]).alias(name)), "record_id", "left")
    for name, df in parts.items():
        out = out.join(df, "record_id", "left")
    held = [*(one or {}), "beats", *[F.coalesce(name, F.array()).alias(name) for name in parts]]
    return out.select("record_id", F.to_json(F.struct(*held)).alias("json"))


def base_key(n_bytes: int, modified: int, annotations: bytes, rules: int, gain: float | None = None, invert: bool = False) -> str:
    """Key of the tables that depend on a record alone, its annotations included."""
    return f"{n_bytes}-{modified}{f'-g{gain}' if gain else ''}{'-inv' if invert else ''}-a{rules}-{zlib.crc32(annotations):08x}"


def cached(spark: SparkSession, folder: str, name: str, key: str, make) -> DataFrame:
    """The table under its key, made on first use."""
    path = f"{folder}/{name}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_records(spark: SparkSession, folder: str, name: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a table for records under their keys; keys: record_id, key (see base_key), a row per record.

    make(record_id rows) gives the table for records, with record_id; it is called once for all those that are not held under their key,
    and for these alone. Rows of a call lie in a folder of their own; the keys are written after them, so that a call that fails has
    made nothing known. A record whose rows are none is held as such. Rows under former keys stay and are not read.
    """
    base, hadoop = f"{folder}/{name}", spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = "record_id long, key string, made string"
    known = spark.read.schema(held).parquet(f"{base}/keys") if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/keys/_SUCCESS")) else spark.createDataFrame([], held)
    missing = checkpointed(keys.select("record_id", "key").join(known, ["record_id", "key"], "left_anti"))
    if missing.take(1):
        made = uuid.uuid4().hex
        make(missing.select("record_id")).write.parquet(f"{base}/rows/made={made}")
        missing.withColumn("made", F.lit(made)).write.mode("append").parquet(f"{base}/keys")
        known = spark.read.schema(held).parquet(f"{base}/keys")
    # Two calls at once may both have made a record; one of them counts.
    wanted = keys.join(known, ["record_id", "key"]).groupBy("record_id").agg(F.min("made").alias("made"))
    return spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").withColumn("made", F.col("made").cast("string")).join(wanted, ["record_id", "made"], "left_semi").drop("made")
