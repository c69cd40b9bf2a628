"""Rhythm: intervals between beats, heart rate, variability, sleep, irregularity. Inputs hold beats (record_id, k, t_ms, label),
k counting from 0 by time; every window runs over one record, which is what the data is partitioned by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sql import operator

#: Limits of an interval between two beats in a row, in ms.
MIN_RR, MAX_RR = 300, 2000

rr = operator(
    """
    SELECT record_id, k, t_ms, label, lead(t_ms) OVER (PARTITION BY record_id ORDER BY k) - t_ms AS rr,
           lead(label) OVER (PARTITION BY record_id ORDER BY k) AS next_label
    FROM {beat}
    """
)

nn_intervals = operator("SELECT record_id, k, t_ms, rr AS nn FROM {rr} WHERE label = 'N' AND next_label = 'N' AND rr > {low} AND rr < {high}", low=MIN_RR, high=MAX_RR)



def beside(column: str, first: int, last: int) -> str:
    """The column first to last rows before a row of its record, as an array (after it where negative). Frames that slide over sorted rows
    are built anew for each row; these are taken from the rows' places."""
    return f"array({', '.join(f'lag({column}, {i}) OVER (PARTITION BY record_id ORDER BY k)' for i in range(first, last + 1) if i)})"


def middle(values: str) -> str:
    """The median of a sorted array, null of an empty one."""
    return f"CASE WHEN size({values}) > 0 THEN ({values}[(size({values}) - 1) div 2] + {values}[size({values}) div 2]) / 2e0 END"


rhythm_ref = operator(
    f"""
    SELECT record_id, k, round(coalesce({middle('near')}, {middle('far')}), 4) AS rhythm
    FROM (SELECT record_id, k, sort_array(array_compact(slice(v, 1, 5))) AS near, sort_array(array_compact(v)) AS far
          FROM (SELECT record_id, k, {beside('v', 2, 20)} AS v FROM (SELECT record_id, k, CASE WHEN label = 'N' AND next_label = 'N' THEN rr END AS v FROM {{rr}}) a) b) c
    """,
    """
    SELECT record_id, k, round(coalesce(quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING),
           quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING)), 4) AS rhythm
    FROM (SELECT record_id, k, CASE WHEN label = 'N' AND next_label = 'N' THEN rr END AS v FROM {rr}) a
    """,
)

rr_context = operator(
    f"""
    SELECT record_id, k, (v[7] + v[8]) / 2e0 AS median
    FROM (SELECT record_id, k, sort_array(v) AS v FROM (SELECT record_id, k, array_compact({beside('rr', -8, 8)}) AS v FROM {{rr}} WHERE rr IS NOT NULL) a WHERE size(v) = 16) b
    """,
    """
    SELECT record_id, k, (v[8] + v[9]) / 2e0 AS median
    FROM (SELECT record_id, k, list_sort(list_concat(list(rr) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
                 list(rr) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))) AS v FROM {rr} WHERE rr IS NOT NULL) a
    WHERE len(v) = 16
    """,
)

#: The last minute of each record; minutes count from 0.
span = operator("SELECT record_id, max(t_ms) AS total_ms FROM {beat} GROUP BY record_id")
minute_spine = operator("SELECT record_id, explode(sequence(cast(0 as bigint), total_ms div 60000)) AS m FROM {span}")

hr_per_minute = operator(
    """
    SELECT s.record_id, s.m, round(CASE WHEN n >= 10 THEN 60000e0 * n / total END, 1) AS hr
    FROM {spine} s LEFT JOIN (SELECT record_id, t_ms div 60000 AS m, count(*) AS n, sum(nn) AS total FROM {nn} GROUP BY record_id, t_ms div 60000) c
    ON s.record_id = c.record_id AND s.m = c.m
    """
)

per_minute_counts = operator(
    """
    SELECT s.record_id, s.m, coalesce(v, 0) AS v, coalesce(s1, 0) AS s
    FROM {spine} s LEFT JOIN (SELECT record_id, t_ms div 60000 AS m, count_if(label = 'V') AS v, count_if(label = 'S') AS s1 FROM {beat} GROUP BY record_id, t_ms div 60000) c
    ON s.record_id = c.record_id AND s.m = c.m
    """
)

hr_windows = operator(
    """
    SELECT record_id, k, t_ms, n, last_t - t_ms AS span, 60000e0 * n / (last_t - t_ms) AS hr
    FROM (SELECT record_id, k, t_ms, count(*) OVER w - 1 AS n, max(t_ms) OVER w AS last_t, sum(good) OVER w - good AS ok
          FROM (SELECT record_id, k, t_ms, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY k) > {low} AND t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY k) < {high} THEN 1 ELSE 0 END AS good FROM {beat}) a
          WINDOW w AS (PARTITION BY record_id ORDER BY t_ms RANGE BETWEEN CURRENT ROW AND {window_ms} FOLLOWING)) b
    WHERE n >= 2 AND last_t - t_ms >= {window_ms} - {high} AND ok = n
    """.replace("count(*) OVER w - 1", "(count(*) OVER w) - 1").replace("sum(good) OVER w - good", "(sum(good) OVER w) - good"),
    low=MIN_RR,
    high=MAX_RR,
    window_ms=15000,
)

hr_extremes = operator(
    """
    SELECT record_id, round(max(CASE WHEN lo = 1 THEN hr END), 4) AS hr_min, max(CASE WHEN lo = 1 THEN t_ms + span div 2 END) AS min_at_ms,
           round(max(CASE WHEN hi = 1 THEN hr END), 4) AS hr_max, max(CASE WHEN hi = 1 THEN t_ms + span div 2 END) AS max_at_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY hr, k) AS lo, row_number() OVER (PARTITION BY record_id ORDER BY hr DESC, k) AS hi FROM {windows}) a
    WHERE lo = 1 OR hi = 1 GROUP BY record_id
    """
)

hr_pct = operator(
    """
    SELECT record_id, round(avg(CASE WHEN 60000e0 / nn > 100 THEN 100e0 ELSE 0e0 END), 2) AS pct_over_100, round(avg(CASE WHEN 60000e0 / nn < 50 THEN 100e0 ELSE 0e0 END), 2) AS pct_under_50
    FROM {nn} GROUP BY record_id
    """
)

sleep_rolling_median = operator(
    """
    SELECT record_id, m, CASE WHEN n >= 5 THEN round(med, 4) END AS median
    FROM (SELECT record_id, m, count(hr) OVER w AS n, percentile(hr, 0.5) OVER w AS med FROM {minutes}
          WINDOW w AS (PARTITION BY record_id ORDER BY m ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) a
    """
)

estimate_sleep = operator(
    """
    SELECT record_id, min(m0) AS m0, max(m1) AS m1
    FROM (SELECT *, sum(CASE WHEN m0 - before <= {merge_gap} THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY m0 ROWS UNBOUNDED PRECEDING) AS g
          FROM (SELECT *, lag(m1) OVER (PARTITION BY record_id ORDER BY m0) AS before
                FROM (SELECT record_id, min(m) AS m0, max(m) + 1 AS m1
                      FROM (SELECT r.record_id, r.m, r.m - row_number() OVER (PARTITION BY r.record_id ORDER BY r.m) AS island
                            FROM {medians} r JOIN (SELECT record_id, percentile(median, 0.1) AS low, percentile(median, 0.5) AS mid, count(median) AS n FROM {medians} GROUP BY record_id) t
                            ON r.record_id = t.record_id WHERE n >= 120 AND median < low + 0.5e0 * (mid - low)) a
                      GROUP BY record_id, island) b) c) d
    GROUP BY record_id, g HAVING max(m1) - min(m0) >= {min_len}
    """,
    min_len=45,
    merge_gap=20,
)

minute_in_sleep = operator(
    """
    SELECT m.record_id, m.m, m.hr, s.m0 IS NOT NULL AS asleep
    FROM {minutes} m LEFT JOIN (SELECT record_id, m0, explode(sequence(m0, m1 - 1)) AS m FROM {sleep}) s ON m.record_id = s.record_id AND m.m = s.m
    """
)

sleep_wake_hr = operator(
    "SELECT record_id, round(avg(CASE WHEN asleep THEN hr END), 4) AS sleep, round(avg(CASE WHEN NOT asleep THEN hr END), 4) AS wake FROM {minutes} GROUP BY record_id"
)

#: start_ms: when a record begins, in ms of its day
day_night_hr = operator(
    """
    SELECT record_id, round(avg(CASE WHEN hour < 6 THEN hr END), 4) AS night, round(avg(CASE WHEN hour >= 8 AND hour < 22 THEN hr END), 4) AS day
    FROM (SELECT record_id, hr, ((m * 60000 + 30000 + {start_ms}) div 3600000) % 24 AS hour FROM {minutes}) a GROUP BY record_id
    """,
    start_ms=29700000,
)

af_screen = operator(
    """
    SELECT record_id, count_if(share >= 0.7e0) AS irregular
    FROM (SELECT record_id, j div 30 AS b, avg(CASE WHEN d > 0.12e0 THEN 1e0 ELSE 0e0 END) AS share
          FROM (SELECT record_id, d, cast(row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 as bigint) AS j, count(*) OVER (PARTITION BY record_id) AS n
                FROM (SELECT record_id, k, abs(nn - before) / cast(before as double) AS d
                      FROM (SELECT record_id, k, nn, lag(nn) OVER (PARTITION BY record_id ORDER BY k) AS before FROM {nn}) a WHERE before IS NOT NULL) b) c
          WHERE (j div 30) * 30 < n - 30 GROUP BY record_id, j div 30) d
    GROUP BY record_id
    """
)

rhythm_summary = operator(
    """
    SELECT b.record_id, b.beats, coalesce(n.nn, 0) AS nn, n.mean_nn, n.median_nn, n.sdnn, b.pauses, b.v_burden
    FROM (SELECT record_id, count(*) AS beats, count_if(rr > 2000) AS pauses, round(avg(CASE WHEN label = 'V' THEN 100e0 ELSE 0e0 END), 4) AS v_burden FROM {rr} GROUP BY record_id) b
    LEFT JOIN (SELECT record_id, count(*) AS nn, round(avg(nn), 4) AS mean_nn, round(percentile(nn, 0.5), 4) AS median_nn, round(stddev_pop(nn), 4) AS sdnn FROM {nn} GROUP BY record_id) n
    ON b.record_id = n.record_id
    """
)

#: Groups of consecutive k among picked beats (record_id, k, t_ms), of at least min_len
runs = operator(
    """
    SELECT record_id, min(k) AS k0, max(k) AS k1, count(*) AS n, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS dur_ms
    FROM (SELECT record_id, k, t_ms, k - row_number() OVER (PARTITION BY record_id ORDER BY k) AS island FROM {picked}) a
    GROUP BY record_id, island HAVING count(*) >= {min_len}
    """,
    min_len=2,
)


#: Time that a segment of the Malik filter spans: with intervals above 300 ms it has 6000 of them at most.
SEGMENT_MS = 1_800_000


def far(v: np.ndarray | int, last: np.ndarray | int) -> np.ndarray | bool:
    """Whether an interval is more than a fifth away from the last kept one."""
    return abs(v - last) / last > 0.2


def kept_after(nn: np.ndarray, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of a segment's intervals are kept where last was the last kept before it, and the last kept after it.

    Only where an interval is far from the one before does the fold have to look: from there to the next kept one.
    """
    kept, k, n = np.ones(len(nn), bool), 0, len(nn)
    if not n:
        return kept, last
    jumps = np.r_[last is not None and far(nn[0], last), far(nn[1:], nn[:-1])]
    at = np.flatnonzero(jumps)
    while True:
        i = np.searchsorted(at, k)
        if i == len(at):
            return kept, int(nn[-1])
        k = int(at[i])
        held = last if k == 0 else int(nn[k - 1])
        off = far(nn[k:], held)
        back = int(off.argmin()) if not off.all() else n - k
        kept[k : k + back] = False
        k += back
        if k == n:
            return kept, held
        k += 1  # the interval at k is kept, whatever the one before was


def ends_of(nn: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The last kept interval after a segment, by the last kept before it: one value once all agree."""
    last = states
    for j, v in enumerate(nn.tolist()):
        last = np.where(far(v, last), last, v)
        if (last == last[0]).all():
            return np.array([kept_after(nn[j + 1 :], int(last[0]))[1]])
    return last


def in_segments(df: DataFrame, keys: list[str], run: Callable[[tuple, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run(key, rows in order of k) for each group of keys, whose rows one task streams: a group is as large as run's input, a task has any number of them."""
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *(["k"] if "k" in df.columns else []))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for x, y in zip([0, *new], [*new, b.num_rows], strict=True):
                own = tuple(c[x] for c in columns)
                if held and own != key:
                    if (out := run(key, joined(held))) is not None:
                        yield out
                    held = []
                key = own
                held.append(b.slice(x, y - x))
        if held and (out := run(key, joined(held))) is not None:
            yield out

    return sorted_rows.mapInArrow(stream, schema)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def malik_filter(nn: DataFrame) -> DataFrame:
    """nn (record_id, k, t_ms, nn) with kept: no more than a fifth away from the last kept interval, in the order of k.

    A fold in time order that no task makes of a whole record: segments of SEGMENT_MS are run from every state that may enter
    them until all states agree; a scan over one row per segment then gives the state that does enter each, and each is run
    once more from it. Of a record that lies in one segment, the state is known.
    """
    rows = nn.select("record_id", "k", "t_ms", "nn", F.expr(f"t_ms div {SEGMENT_MS}").alias("segment"))
    bounds = nn.agg(F.min("nn"), F.max("nn")).first()
    low, high = bounds[0] or 1, bounds[1] or 1
    segments = rows.groupBy("record_id").agg(F.min("segment").alias("first"), F.max("segment").alias("final"))
    # What comes after a record's last segment is of no use to anyone.
    inner = rows.join(segments.filter("first < final"), "record_id").filter("segment < final")

    def ends(key: tuple, b: pa.RecordBatch) -> pa.RecordBatch:
        v = b.column("nn").to_numpy().astype(np.int64)
        found = np.array([kept_after(v, None)[1]]) if b.column("first")[0].as_py() == key[1] else ends_of(v, np.arange(low, high + 1))
        return pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in key] + [pa.array([found.tolist()], pa.list_(pa.int64()))], names=["record_id", "segment", "ends"])

    def entering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = state = None
        for b in batches:
            out = []
            for r, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state = e[0] if len(e) == 1 or r != record else e[state - low]
                record = r
                out.append((r, s, state))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["record_id", "after", "last"])

    summaries = in_segments(inner.select("record_id", "segment", "k", "nn", "first"), ["record_id", "segment"], ends, "record_id long, segment long, ends array<long>")
    passed = summaries.repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(entering, "record_id long, after long, last long")
    # The state after a segment enters the record's next one that has intervals.
    following = rows.select("record_id", "segment").distinct().withColumn("after", F.lag("segment").over(Window.partitionBy("record_id").orderBy("segment"))).filter("after is not null")
    states = following.join(passed, ["record_id", "after"]).select("record_id", "segment", "last")

    def fold(key: tuple, b: pa.RecordBatch) -> pa.RecordBatch:
        kept, _ = kept_after(b.column("nn").to_numpy().astype(np.int64), b.column("last")[0].as_py())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("record_id", "k", "t_ms", "nn")), pa.array(kept)], names=["record_id", "k", "t_ms", "nn", "kept"])

    return in_segments(rows.join(states, ["record_id", "segment"], "left"), ["record_id", "segment"], fold, "record_id long, k long, t_ms long, nn long, kept boolean")


#: The same fold step by step, for engines with recursive queries
MALIK_RECURSIVE = """
WITH RECURSIVE o AS MATERIALIZED (SELECT record_id, k, t_ms, nn, row_number() OVER (PARTITION BY record_id ORDER BY k) AS j FROM {nn}),
f AS (SELECT record_id, k, t_ms, nn, j, true AS kept, nn AS last FROM o WHERE j = 1
      UNION ALL SELECT o.record_id, o.k, o.t_ms, o.nn, o.j, abs(o.nn - f.last) / f.last::DOUBLE <= 0.2e0, CASE WHEN abs(o.nn - f.last) / f.last::DOUBLE <= 0.2e0 THEN o.nn ELSE f.last END
      FROM f JOIN o ON o.record_id = f.record_id AND o.j = f.j + 1)
SELECT record_id, k, t_ms, nn, kept FROM f
"""

hrv = operator(
    """
    SELECT record_id, round(stddev_pop(nn), 4) AS sdnn, round(sqrt(avg(d * d)), 4) AS rmssd, round(avg(CASE WHEN abs(d) > 50 THEN 100e0 WHEN d IS NOT NULL THEN 0e0 END), 4) AS pnn50,
           round(avg(nn), 4) AS mean_rr, count(*) AS n
    FROM (SELECT record_id, cast(nn as double) AS nn, cast(nn - lag(nn) OVER (PARTITION BY record_id ORDER BY k) as double) AS d FROM {filtered} WHERE kept) a GROUP BY record_id
    """
)

hr_mean = operator("SELECT record_id, round(60000e0 / avg(nn), 4) AS hr FROM {filtered} WHERE kept GROUP BY record_id")
