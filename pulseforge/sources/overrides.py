"""A reviewer's edits at rest: a JSON object per record, by record_id, as labels, inserted beats, quality spans, diary and report.

In a record's object labels and inserted beats are maps from a time to a label; the order of spans is that in which they were made.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "record_id long, labels map<string,string>, added map<string,string>, quality array<struct<t0_ms:long,t1_ms:long,v:string>>, "
    "events array<struct<id:long,t_ms:long,text:string>>, report string"
)


@dataclass
class Overrides:
    labels: DataFrame  #: record_id, t_ms, label
    added: DataFrame  #: record_id, t_ms, label
    quality: DataFrame  #: record_id, seq, t0_ms, t1_ms, v
    events: DataFrame  #: record_id, id, t_ms, text
    report: DataFrame  #: record_id, report (JSON)


def read_overrides(spark: SparkSession, path: str) -> Overrides:
    """Absent files are no edits."""
    try:
        rows = spark.read.schema(SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    by_time = lambda c: rows.select("record_id", F.explode(c).alias("t", "label")).select("record_id", F.col("t").cast("long").alias("t_ms"), "label")
    return Overrides(
        by_time("labels"),
        by_time("added"),
        rows.select("record_id", F.posexplode("quality").alias("seq", "q")).select("record_id", F.col("seq").cast("long").alias("seq"), "q.*"),
        rows.select("record_id", F.inline("events")),
        rows.select("record_id", "report").filter("report is not null"),
    )


def write_overrides(overrides: Overrides, path: str) -> None:
    """Writes the whole of the edits to a new folder: a folder that is read cannot be its own target. A record's edits, which a person
    makes one by one, are gathered into its row; of two labels of one time the last by name stays."""
    of = lambda x, f: x.groupBy("record_id").agg(f.alias("value"))
    labelled = lambda x: of(x.groupBy("record_id", "t_ms").agg(F.max("label").alias("label")), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("t_ms").cast("string"), "label")))))
    spans = of(overrides.quality, F.transform(F.array_sort(F.collect_list(F.struct("seq", "t0_ms", "t1_ms", "v"))), lambda q: F.struct(q["t0_ms"].alias("t0_ms"), q["t1_ms"].alias("t1_ms"), q["v"].alias("v"))))
    parts = {
        "labels": labelled(overrides.labels), "added": labelled(overrides.added), "quality": spans,
        "events": of(overrides.events, F.array_sort(F.collect_list(F.struct("id", "t_ms", "text")))), "report": of(overrides.report, F.max("report")),
    }
    whole = None
    for f in fields(Overrides):
        part = parts[f.name].withColumnRenamed("value", f.name)
        whole = part if whole is None else whole.join(part, "record_id", "full")
    whole.write.json(path)
