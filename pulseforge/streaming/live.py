"""The order-dependent steps over beats and edits that still arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Intervals(StatefulProcessor):
    """Beats of a record wait until the watermark has passed them, so that late ones fall into their places; then the intervals between
    them are final. State: beats that wait, and the last final beat with the last kept interval; both go when a record falls silent."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms long, t_ms long, label string")
        self.last = handle.getValueState("last", "t_ms long, label string, nn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            ts = (frame["ts"].astype("datetime64[ms]").astype("int64")).to_numpy()
            for at, t, label in zip(ts.tolist(), frame["t_ms"].tolist(), frame["label"].tolist(), strict=True):
                self.waiting.appendValue((at, int(t), label))
            if len(ts):
                latest = int(ts.max()) if latest is None else max(latest, int(ts.max()))
        if latest is not None:
            # Once for these beats; and once, long after, to forget the record.
            self.handle.registerTimer(latest)
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame(columns=["record_id", "t_ms", "nn", "kept"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        beats = sorted(self.waiting.get(), key=lambda b: b[1]) if self.waiting.exists() else []
        final, rest = [b for b in beats if b[0] <= passed], [b for b in beats if b[0] > passed]
        last_t, last_label, last_nn = self.last.get() if self.last.exists() else (None, None, None)
        out = []
        for _, t, label in final:
            gap = None if last_t is None else t - last_t
            if gap is not None and label == last_label == "N" and 300 < gap < 2000:
                kept = last_nn is None or abs(gap - last_nn) / last_nn <= 0.2
                out.append((key[0], last_t, gap, kept))
                last_nn = gap if kept else last_nn
            last_t, last_label = t, label
        if final:
            self.last.update((last_t, last_label, last_nn))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
            if expiredTimerInfo.getExpiryTimeInMs() >= max(self.handle.listTimers(), default=0):
                self.last.clear()
        yield pd.DataFrame(out, columns=["record_id", "t_ms", "nn", "kept"])


def live_intervals(beats: DataFrame, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """(record_id, t_ms, nn, kept) of a stream of beats (record_id, ts, t_ms, label), ts the clock time of t_ms: the N-N intervals, and
    whether they are within a fifth of the last kept one, as the batch query has them. A beat that comes late, but within the watermark,
    is where it belongs; one beyond it is dropped. A record that is silent for idle_ms begins anew. Needs the RocksDB state store."""
    return beats.withWatermark("ts", late).groupBy("record_id").transformWithStateInPandas(Intervals(idle_ms), "record_id long, t_ms long, nn long, kept boolean", "Append", "EventTime")


def live_labels(edits: DataFrame, late: str | None = None) -> DataFrame:
    """(record_id, t_ms, label, seq) of a stream of edits (record_id, t_ms, seq, label): the latest of each beat, in update mode. With late,
    edits have a time (ts): repeated deliveries of one within it are dropped, and their state ends there; the latest labels, one per beat
    that was ever edited, stay."""
    once = edits if late is None else edits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record_id", "seq"])
    return once.groupBy("record_id", "t_ms").agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"))


def live_minutes(beats: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Beats per minute of wall clock and record of a stream of beats (record_id, ts, label), final once the watermark has passed."""
    window = F.window("ts", "1 minute")
    return beats.withWatermark("ts", late).groupBy("record_id", window).agg(F.count("*").alias("beats"), F.count_if(F.col("label") == "V").alias("v"), F.count_if(F.col("label") == "S").alias("s"))


def live_runs(beats: DataFrame, gap: str = "2 seconds", late: str = "5 minutes") -> DataFrame:
    """Sessions of V beats of a record that follow one another within gap."""
    v = beats.filter("label = 'V'").withWatermark("ts", late)
    return v.groupBy("record_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
