"""A reviewer's edits as an append-only log, of which the latest counts, and what beats, noise and audits are with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sql import operator

LABELS = ("N", "V", "S", "X")

#: (record_id, t_ms, label): the last entry of each time; a null label clears.
latest_labels = operator(
    "SELECT record_id, t_ms, label FROM (SELECT *, row_number() OVER (PARTITION BY record_id, t_ms ORDER BY seq DESC) AS r FROM {log}) a WHERE r = 1 AND label IS NOT NULL"
)

#: Spans without those that a later clearing (null value) intersects
live_spans = operator(
    """
    SELECT s.record_id, s.seq, s.t0_ms, s.t1_ms, s.v FROM {log} s
    WHERE s.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {log} c WHERE c.v IS NULL AND c.record_id = s.record_id AND c.seq > s.seq AND s.t1_ms > c.t0_ms AND s.t0_ms < c.t1_ms)
    """
)

#: Device beats and inserted ones by time (device first on a tie), relabelled by time: only the first beat of a time is.
merge_beats = operator(
    """
    SELECT m.record_id, m.k, m.t_ms, m.origin, m.device_label, CASE WHEN same = 1 THEN coalesce(l.label, m.label) ELSE m.label END AS label, l.label IS NOT NULL AND same = 1 AS relabelled
    FROM (SELECT *, cast(row_number() OVER (PARTITION BY record_id ORDER BY t_ms, added, origin) - 1 as bigint) AS k, row_number() OVER (PARTITION BY record_id, t_ms ORDER BY added, origin) AS same
          FROM (SELECT record_id, t_ms, label, label AS device_label, k AS origin, 0 AS added FROM {device}
                UNION ALL SELECT record_id, t_ms, label, cast(NULL as string) AS device_label, cast(-1 as bigint) AS origin, 1 AS added FROM {inserted}) u) m
    LEFT JOIN {labels} l ON m.record_id = l.record_id AND m.t_ms = l.t_ms
    """
)

#: Audits by merged beats: a manual label overrides the verdict. audit: of the device's beats, with their families; features: of them
#: and of the device's beats that a label by hand makes audited ones, which have no family then.
effective_audits = operator(
    """
    SELECT b.record_id, b.k, b.t_ms, b.label, coalesce(a.family, -1) AS family, a.family_n_frac, q.rr_pre, q.rr_post, CASE WHEN NOT q.edge THEN q.amp_ratio END AS amp_ratio, CASE WHEN NOT q.edge THEN q.noise_ratio END AS noise_ratio,
           CASE WHEN NOT q.edge THEN q.width_ms END AS width_ms, CASE WHEN NOT q.edge THEN q.width_ratio END AS width_ratio, CASE WHEN NOT q.edge THEN q.prematurity END AS prematurity,
           CASE WHEN b.origin < 0 OR b.relabelled THEN CASE WHEN b.label IN ('V', 'S') THEN 'manual' WHEN b.label = 'N' THEN 'manual-N' ELSE 'manual-X' END ELSE a.verdict END AS verdict,
           CASE WHEN b.origin < 0 OR b.relabelled THEN 1e0 ELSE a.confidence END AS confidence,
           CASE WHEN b.origin < 0 THEN concat('добавлен вручную: ', b.label) WHEN b.relabelled THEN concat('ручная метка: ', b.label) END AS reason
    FROM {beat} b LEFT JOIN {audit} a ON b.record_id = a.record_id AND b.origin = a.k LEFT JOIN {features} q ON b.record_id = q.record_id AND b.origin = q.k
    WHERE b.origin < 0 OR b.relabelled OR a.k IS NOT NULL
    """
)

#: Noise windows of 2 s under spans: the last span that touches a window decides it.
apply_quality = operator(
    """
    SELECT n.record_id, n.w, CASE WHEN s.v IS NULL THEN n.noise WHEN s.v = 'clean' THEN 0e0 ELSE 1e0 END AS noise, CASE WHEN s.v IS NULL THEN n.sharp WHEN s.v = 'clean' THEN 0e0 ELSE 1e0 END AS sharp
    FROM {noise} n
    LEFT JOIN (SELECT record_id, w, v FROM (SELECT record_id, w, v, row_number() OVER (PARTITION BY record_id, w ORDER BY seq DESC) AS r
               FROM (SELECT record_id, seq, v, explode(sequence(t0_ms div 2000, (t1_ms + 1999) div 2000 - 1)) AS w FROM {spans} WHERE t1_ms > t0_ms) x) y WHERE r = 1) s
    ON n.record_id = s.record_id AND n.w = s.w
    """
)

#: Audited beats inside spans and their neighbours, which are audited anew
touched_beats = operator(
    """
    SELECT DISTINCT b.record_id, b.k FROM {beat} b
    JOIN (SELECT d.record_id, explode(sequence(d.k - 1, d.k + 1)) AS k FROM {beat} d JOIN (SELECT record_id, t0_ms, t1_ms, explode(sequence(t0_ms div 2000, (t1_ms - 1) div 2000)) AS w FROM {spans} WHERE t1_ms > t0_ms) s
          ON d.record_id = s.record_id AND d.t_ms div 2000 = s.w AND d.t_ms >= s.t0_ms AND d.t_ms < s.t1_ms WHERE d.label <> 'N') t
    ON b.record_id = t.record_id AND b.k = t.k WHERE b.label <> 'N'
    """
)

#: Features of the touched beats under the windows of noise as the spans leave them (the last window serves what lies beyond it);
#: nothing else of a feature depends on spans, so no sample is read again. Stored windows have two decimals.
reaudit_features = operator(
    """
    SELECT f.record_id, f.k, f.t_ms, f.label, f.rr_pre, f.rr_post, f.edge, f.amp_ratio, f.noise_ratio, f.noise_mv, f.ref_amp, round(n.sharp, 2) AS win_noise, f.width_ms, f.sinus_width, f.width_ratio, f.prematurity
    FROM {features} f JOIN {touched} t ON f.record_id = t.record_id AND f.k = t.k JOIN (SELECT record_id, max(w) AS last_w FROM {noise} GROUP BY record_id) l ON f.record_id = l.record_id
    JOIN {noise} n ON f.record_id = n.record_id AND n.w = least(f.t_ms div 2000, l.last_w)
    """
)

#: Audits with those of the fresh ones in place of their own, by key
replaced_audits = operator(
    """
    SELECT a.record_id, a.k, a.t_ms, a.label, a.family, a.family_n_frac, a.before, a.verdict, a.confidence FROM {audit} a LEFT JOIN {fresh} f ON a.record_id = f.record_id AND a.k = f.k WHERE f.k IS NULL
    UNION ALL SELECT record_id, k, t_ms, label, family, family_n_frac, before, verdict, confidence FROM {fresh}
    """
)

#: What the rhythm did within 120 s of each diary entry. The intervals that enter and leave the band count too. Entries and what
#: is near them meet in stretches b of 120 s, counted from 120 s before the record; what lies in several counts in the first that both are in.
event_context = operator(
    """
    SELECT e.record_id, e.id, e.t_ms, e.text, h.hr, h.hr_min, h.hr_max, coalesce(v, 0) AS v, coalesce(s, 0) AS s, coalesce(p.episodes, 0) AS episodes, coalesce(n.noise, 0e0) AS noise
    FROM {diary} e
    LEFT JOIN (SELECT record_id, id, bround(60000 / avg(rr), 0) AS hr, bround(60000 / cast(max(rr) as double), 0) AS hr_min, bround(60000 / cast(min(rr) as double), 0) AS hr_max
               FROM (SELECT d.record_id, d.id, r.rr, count_if(r.t_ms >= d.t_ms - 120000 AND r.t_ms < d.t_ms + 120000) OVER (PARTITION BY d.record_id, d.id) AS inside
                     FROM (SELECT record_id, id, t_ms, explode(sequence(t_ms div 120000, t_ms div 120000 + 2)) AS b FROM {diary}) d
                     JOIN (SELECT record_id, t_ms, rr, explode(sequence((t_ms + 120000) div 120000, (t_ms + coalesce(rr, 0) + 120000) div 120000)) AS b FROM {rr}) r
                     ON d.record_id = r.record_id AND d.b = r.b AND d.b = greatest(d.t_ms div 120000, (r.t_ms + 120000) div 120000) AND r.t_ms < d.t_ms + 120000 AND r.t_ms + coalesce(r.rr, 0) >= d.t_ms - 120000) x
               WHERE inside > 0 AND rr > 300 AND rr < 2000 GROUP BY record_id, id) h ON e.record_id = h.record_id AND e.id = h.id
    LEFT JOIN (SELECT d.record_id, d.id, count_if(a.label = 'V') AS v, count_if(a.label = 'S') AS s FROM (SELECT record_id, id, t_ms, explode(sequence(t_ms div 120000, t_ms div 120000 + 2)) AS b FROM {diary}) d JOIN {audit} a
               ON d.record_id = a.record_id AND d.b = (a.t_ms + 120000) div 120000 AND a.t_ms >= d.t_ms - 120000 AND a.t_ms < d.t_ms + 120000 WHERE a.verdict IN ('likely', 'uncertain', 'manual') GROUP BY d.record_id, d.id) c ON e.record_id = c.record_id AND e.id = c.id
    LEFT JOIN (SELECT d.record_id, d.id, count(*) AS episodes FROM (SELECT record_id, id, t_ms, explode(sequence(t_ms div 120000, t_ms div 120000 + 2)) AS b FROM {diary}) d
               JOIN (SELECT record_id, t_ms, dur_ms, verdict, explode(sequence((t_ms + 120000) div 120000, (t_ms + dur_ms + 120000) div 120000)) AS b FROM {episode}) x
               ON d.record_id = x.record_id AND d.b = x.b AND d.b = greatest(d.t_ms div 120000, (x.t_ms + 120000) div 120000) AND x.t_ms <= d.t_ms + 120000 AND x.t_ms + x.dur_ms >= d.t_ms - 120000
               WHERE x.verdict <> 'artifact' GROUP BY d.record_id, d.id) p ON e.record_id = p.record_id AND e.id = p.id
    LEFT JOIN {noise} n ON e.record_id = n.record_id AND n.w = e.t_ms div 2000
    """
)

#: Whether a beat may be inserted at a time: none within 120 ms
insertable = operator(
    """
    SELECT i.record_id, i.t_ms, i.label, count(b.k) = 0 AS allowed FROM (SELECT *, explode(sequence(t_ms div 120 - 1, t_ms div 120 + 1)) AS b FROM {wanted}) i LEFT JOIN {beat} b ON i.record_id = b.record_id AND i.b = b.t_ms div 120 AND b.t_ms > i.t_ms - 120 AND b.t_ms < i.t_ms + 120
    GROUP BY i.record_id, i.t_ms, i.label
    """
)

export_beats = operator("SELECT record_id, k, t_ms, label, device_label FROM {beat}")

beat_info = operator(
    """
    SELECT b.record_id, b.k, b.t_ms, coalesce(a.label, b.label) AS label, b.device_label, b.origin < 0 AS added, coalesce(a.verdict, 'N') AS verdict, coalesce(a.confidence, 1e0) AS confidence,
           CASE coalesce(a.verdict, 'N') WHEN 'N' THEN 0 WHEN 'manual-N' THEN 0 WHEN 'likely' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'manual' THEN 4 ELSE 3 END AS class_code,
           CASE coalesce(a.label, b.label) WHEN 'V' THEN 1 WHEN 'S' THEN 2 WHEN 'X' THEN 3 ELSE 0 END AS label_code
    FROM {beat} b LEFT JOIN {audit} a ON b.record_id = a.record_id AND b.k = a.k
    """
)

beats_window = operator(
    "SELECT record_id, k, t_ms, label, coalesce(t_ms - before, 0) AS rr_ms FROM (SELECT *, lag(t_ms) OVER (PARTITION BY record_id ORDER BY k) AS before FROM {beat}) a WHERE t_ms >= {start_s} * 1000 AND t_ms < ({start_s} + {dur_s}) * 1000",
    start_s=600,
    dur_s=900,
)

edit_counts = operator(
    """
    SELECT record_id, cast(sum(manual) as bigint) AS manual, cast(sum(added) as bigint) AS added, cast(sum(quality_spans) as bigint) AS quality_spans
    FROM (SELECT record_id, 0 AS manual, 0 AS added, 0 AS quality_spans FROM {span} UNION ALL SELECT record_id, 1, 0, 0 FROM {labels} UNION ALL SELECT record_id, 0, 1, 0 FROM {inserted} UNION ALL SELECT record_id, 0, 0, 1 FROM {spans}) x GROUP BY record_id
    """
)

#: Edits of the one long record, by numbers in props (fixed choices)
stand_in_labels = operator("SELECT record_id, t_ms, event_id AS seq, CASE pk % 20 WHEN 3 THEN 'N' WHEN 13 THEN CASE WHEN event_id % 4 = 0 THEN 'X' WHEN event_id % 4 = 1 THEN cast(NULL as string) ELSE 'V' END END AS label FROM {beat} WHERE pk % 10 = 3")
stand_in_inserted = operator("SELECT record_id, t_ms + 137 AS t_ms, CASE WHEN event_id % 2 = 0 THEN 'V' ELSE 'S' END AS label FROM {beat} WHERE pk % 25 = 6")
stand_in_spans = operator("SELECT record_id, event_id AS seq, t_ms AS t0_ms, t_ms + 5000 AS t1_ms, CASE pk WHEN 7 THEN 'noise' WHEN 8 THEN 'clean' END AS v FROM {beat} WHERE pk IN (7, 8) OR (pk = 9 AND event_id % 5 = 0)")
stand_in_diary = operator("SELECT record_id, cast(row_number() OVER (PARTITION BY record_id ORDER BY t_ms) as bigint) AS id, t_ms, 'symptom' AS text FROM {beat} WHERE pk = 11")
stand_in_noise = operator(
    """
    SELECT s.record_id, s.w, coalesce(x, 0e0) AS noise, coalesce(x, 0e0) * 0.9e0 AS sharp
    FROM (SELECT record_id, explode(sequence(cast(0 as bigint), total_ms div 2000 - 1)) AS w FROM {span}) s
    LEFT JOIN (SELECT record_id, t_ms div 2000 AS w, max(value) / 500e0 AS x FROM {beat} WHERE pk < 60 GROUP BY record_id, t_ms div 2000) n ON s.record_id = n.record_id AND s.w = n.w
    """
)


def set_label(log: DataFrame, record_id: int, t_ms: int, label: str | None) -> DataFrame:
    """The log with one more entry; None clears."""
    if label is not None and label not in LABELS:
        raise ValueError(f"label must be one of {sorted(LABELS)}")
    entry = log.sparkSession.createDataFrame([(record_id, t_ms, label)], "record_id long, t_ms long, label string")
    return log.unionByName(entry.crossJoin(log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))).select(log.columns))


def set_quality(log: DataFrame, record_id: int, t0_ms: int, t1_ms: int, value: str | None) -> DataFrame:
    if value not in ("clean", "noise", None):
        raise ValueError("value must be clean, noise or null")
    entry = log.sparkSession.createDataFrame([(record_id, min(t0_ms, t1_ms), max(t0_ms, t1_ms), value)], "record_id long, t0_ms long, t1_ms long, v string")
    return log.unionByName(entry.crossJoin(log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))).select(log.columns))


def add_beat(inserted: DataFrame, beats: DataFrame, record_id: int, t_ms: int, label: str = "N") -> DataFrame:
    """inserted with one more beat, unless one of beats (device and inserted ones) is within 120 ms of it."""
    if label not in LABELS:
        raise ValueError(f"label must be one of {sorted(LABELS)}")
    wanted = beats.sparkSession.createDataFrame([(record_id, t_ms, label)], "record_id long, t_ms long, label string")
    if not insertable(wanted=wanted, beat=beats.filter(F.col("t_ms").between(t_ms - 120, t_ms + 120))).first()["allowed"]:
        raise ValueError("a beat is within 120 ms of that time: set its label instead")
    return inserted.unionByName(wanted.select(inserted.columns))


def set_report(reports: DataFrame, record_id: int, report: str | None) -> DataFrame:
    """reports (record_id, report) with one record's text in JSON in place of what it had; None clears."""
    kept = reports.filter(F.col("record_id") != record_id)
    return kept if report is None else kept.unionByName(reports.sparkSession.createDataFrame([(record_id, report)], "record_id long, report string"))


def annotate(log: DataFrame, inserted: DataFrame, beats: DataFrame, record_id: int, k: int, label: str | None) -> tuple[DataFrame, DataFrame]:
    """The label log and the inserted beats after a label for beat k of the merged beats: of a device's beat it is logged (None clears), of
    an inserted one it replaces the label (None removes the beat)."""
    beat = beats.filter((F.col("record_id") == record_id) & (F.col("k") == k)).select("t_ms", "origin").first()
    if beat is None:
        raise IndexError("the record has no such beat")
    if beat["origin"] >= 0:
        return set_label(log, record_id, beat["t_ms"], label), inserted
    if label is not None and label not in LABELS:
        raise ValueError(f"label must be one of {sorted(LABELS)}")
    kept = inserted.filter((F.col("record_id") != record_id) | (F.col("t_ms") != beat["t_ms"]))
    return log, kept if label is None else kept.unionByName(inserted.sparkSession.createDataFrame([(record_id, beat["t_ms"], label)], "record_id long, t_ms long, label string").select(inserted.columns))


def add_event(diary: DataFrame, record_id: int, t_ms: int, text: str, total_ms: int | None = None) -> DataFrame:
    """The diary with one more entry; its number is the record's next. total_ms: the record's length, beyond which no entry lies."""
    if t_ms < 0 or total_ms is not None and t_ms > total_ms:
        raise ValueError("the time lies outside the record")
    own = diary.filter(F.col("record_id") == record_id)
    entry = diary.sparkSession.createDataFrame([(record_id, t_ms, text.strip()[:200])], "record_id long, t_ms long, text string")
    return diary.unionByName(entry.crossJoin(own.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))).select(diary.columns))


def remove_event(diary: DataFrame, record_id: int, event_id: int) -> DataFrame:
    return diary.filter((F.col("record_id") != record_id) | (F.col("id") != event_id))


def set_template_label(log: DataFrame, members: DataFrame, label: str | None) -> DataFrame:
    """A label for every device beat (record_id, t_ms) of a family."""
    if label is not None and label not in LABELS:
        raise ValueError(f"label must be one of {sorted(LABELS)}")
    seq = log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return log.unionByName(members.select("record_id", "t_ms").crossJoin(seq).withColumn("label", F.lit(label).cast("string")).select(log.columns))
