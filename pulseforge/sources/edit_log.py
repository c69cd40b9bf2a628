"""A reviewer's edits as a log that is read and written in place.

A commit is a folder of rows and a marker `log/<number>.commit` that names it. The marker is made only if it is not there, which
a store does for one writer alone: of two writers of one number the other takes the next. So a reader sees whole commits, in one
order, and rows of a writer that was lost are in no marker. A compaction is a commit of all that is in force; readers begin at
the last of these, and vacuum() removes what lies before it. Many records share a log, and a commit may hold edits of any number
of them; what is in force follows by the last entry of each key, as in operators.edits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import LABELS, latest_labels, live_spans
from .overrides import Overrides

#: kind: label, beat, quality, event, report. t_ms and t1_ms: the time, or a span's ends. id: of an event. value: a label, clean or noise, a
#: text; null takes back. place: the order within a commit.
ENTRY = "record_id long, kind string, t_ms long, t1_ms long, id long, value string, place long"
KINDS = {"label": LABELS, "beat": LABELS, "quality": ("clean", "noise"), "event": None, "report": None}


@dataclass
class Commit:
    number: int
    folder: str
    whole: bool  #: holds all that is in force


class EditLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.lines = jvm.org.apache.commons.io.IOUtils

    def commits(self) -> list[Commit]:
        """From the last whole one on, in order."""
        place = self.path(f"{self.folder}/log")
        if not self.store.exists(place):
            return []
        found = []
        for status in self.store.listStatus(place):
            name = status.getPath().getName()
            if name.endswith(".commit"):
                found.append((int(name.removesuffix(".commit")), status.getPath()))
        out: list[Commit] = []
        for number, marker in sorted(found, key=lambda x: -x[0]):
            stream = self.store.open(marker)
            try:
                said = json.loads(bytes(self.lines.toByteArray(stream)))
            finally:
                stream.close()
            out.append(Commit(number, said["folder"], said["whole"]))
            if said["whole"]:
                break
        return out[::-1]

    def entries(self) -> DataFrame:
        """ENTRY rows and seq, their order over all commits."""
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], f"{ENTRY}, seq long")
        rows = self.spark.read.schema(ENTRY).parquet(*(f"{self.folder}/data/{c.folder}" for c in commits))
        numbers = self.spark.createDataFrame([(c.folder, c.number) for c in commits], "folder string, number long")
        named = rows.withColumn("folder", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
        return named.join(F.broadcast(numbers), "folder").withColumn("seq", F.shiftleft("number", 32) + F.col("place")).drop("folder", "number")

    def write(self, rows: DataFrame, whole: bool = False, after: int | None = None) -> int:
        """A commit of ENTRY rows; its number. after: the only number it may follow, else it fails (and changes nothing)."""
        name = uuid.uuid4().hex
        rows.select(*[c.split()[0] for c in ENTRY.split(", ")]).write.parquet(f"{self.folder}/data/{name}")
        self.store.mkdirs(self.path(f"{self.folder}/log"))
        number = 1 + (max((c.number for c in self.commits()), default=0) if after is None else after)
        while True:
            try:
                # Fails where another has made it: then that commit is before this one.
                marker = self.store.create(self.path(f"{self.folder}/log/{number:020d}.commit"), False)
            except Py4JJavaError as e:
                if "already exists" not in str(e.java_exception).lower() and "exist" not in type(e.java_exception).__name__.lower():
                    raise
                if after is not None:
                    raise RuntimeError("others have written meanwhile") from e
                number += 1
                continue
            marker.write(bytearray(json.dumps({"folder": name, "whole": whole}).encode()))
            marker.close()
            return number

    def append(self, entries: list[tuple] | DataFrame) -> int:
        """A commit of (record_id, kind, t_ms, t1_ms, id, value), in their order, or of ENTRY rows. Labels and kinds are checked first."""
        if isinstance(entries, DataFrame):
            known = F.lit(False)
            for kind, values in KINDS.items():
                known = known | ((F.col("kind") == kind) & (F.col("value").isNull() | (F.col("value").isin(*values) if values else F.lit(True))))
            if entries.filter(~F.coalesce(known, F.lit(False))).limit(1).count():
                raise ValueError("an entry has a kind or a value that is not known")
            return self.write(entries)
        for _, kind, _, _, _, value in entries:
            if kind not in KINDS or value is not None and KINDS[kind] and value not in KINDS[kind]:
                raise ValueError(f"{kind} cannot be {value}")
        return self.write(self.spark.createDataFrame([(*e, k) for k, e in enumerate(entries)], ENTRY))

    def state(self) -> Overrides:
        """What is in force."""
        rows = self.entries()
        of = lambda kind: rows.filter(F.col("kind") == kind)
        by_time = lambda kind: latest_labels(log=of(kind).select("record_id", "t_ms", "seq", F.col("value").alias("label")))
        spans = live_spans(log=of("quality").select("record_id", "seq", F.col("t_ms").alias("t0_ms"), "t1_ms", F.col("value").alias("v")))
        last = lambda kind, *key: of(kind).groupBy("record_id", *key).agg(F.max_by(F.struct("t_ms", "value"), "seq").alias("x")).filter("x.value is not null")
        events = last("event", "id").select("record_id", "id", "x.t_ms", F.col("x.value").alias("text"))
        return Overrides(by_time("label"), by_time("beat"), spans, events, last("report").select("record_id", F.col("x.value").alias("report")))

    def compact(self) -> int:
        """All that is in force as one commit. Fails, and changes nothing, where another commit came first."""
        after = max((c.number for c in self.commits()), default=0)
        s = self.state()
        none = lambda kind: F.lit(None).cast(kind)
        row = lambda kind, t, t1, i, value: (F.col("record_id"), F.lit(kind).alias("kind"), t.alias("t_ms"), t1.alias("t1_ms"), i.alias("id"), value.alias("value"))
        parts = [
            s.labels.select(*row("label", F.col("t_ms"), none("long"), none("long"), F.col("label")), F.lit(0).cast("long").alias("place")),
            s.added.select(*row("beat", F.col("t_ms"), none("long"), none("long"), F.col("label")), F.lit(0).cast("long").alias("place")),
            # The order of spans counts within a record.
            s.quality.select(*row("quality", F.col("t0_ms"), F.col("t1_ms"), none("long"), F.col("v")), F.expr("cast(row_number() over (partition by record_id order by seq) as bigint)").alias("place")),
            s.events.select(*row("event", F.col("t_ms"), none("long"), F.col("id"), F.col("text")), F.lit(0).cast("long").alias("place")),
            s.report.select(*row("report", none("long"), none("long"), none("long"), F.col("report")), F.lit(0).cast("long").alias("place")),
        ]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return self.write(whole, True, after)

    def vacuum(self) -> int:
        """Removes markers before the last whole commit, and folders that no marker names; how many. Not while others read or write."""
        commits = self.commits()
        keep, first = {c.folder for c in commits}, commits[0].number if commits else 0
        gone = 0
        for sub, kept in (("log", lambda n: int(n.removesuffix(".commit")) >= first), ("data", lambda n: n in keep)):
            place = self.path(f"{self.folder}/{sub}")
            for status in self.store.listStatus(place) if self.store.exists(place) else []:
                if not kept(status.getPath().getName()):
                    gone += bool(self.store.delete(status.getPath(), True))
        return gone
