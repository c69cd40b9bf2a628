"""Views that screens and reports read: one row per record, minute or family. Texts are fixed values."""

from __future__ import annotations

from .sql import operator

overview = operator(
    """
    SELECT h.record_id, h.m, h.hr, c.v AS v_device, coalesce(a.v, 0) AS v, coalesce(a.s, 0) AS s
    FROM {minutes} h JOIN {counts} c ON h.record_id = c.record_id AND h.m = c.m
    LEFT JOIN (SELECT record_id, t_ms div 60000 AS m, count_if(label = 'V') AS v, count_if(label = 'S') AS s FROM {audit} WHERE verdict IN ('likely', 'uncertain', 'manual') GROUP BY record_id, t_ms div 60000) a ON h.record_id = a.record_id AND h.m = a.m
    """
)

#: span and device: of the device's beats; total, extremes, pct and pauses: of the merged ones
summary = operator(
    """
    SELECT s.record_id, round(s.total_ms / 1000e0, 1) AS duration_s, t.beats, d.n AS device_n, d.v AS device_v, d.s AS device_s, a.v AS kept_v, a.v_likely, a.s AS kept_s, q.clean_pct, p.device AS pauses_device, p.real AS pauses_real,
           b.v_burden, x.hr_min, x.min_at_ms div 1000 AS min_at_s, x.hr_max, x.max_at_ms div 1000 AS max_at_s, n.night, n.day, w.sleep, w.wake, h.pct_over_100, h.pct_under_50
    FROM {span} s JOIN {device} d ON s.record_id = d.record_id JOIN {total} t ON s.record_id = t.record_id LEFT JOIN {audited} a ON s.record_id = a.record_id LEFT JOIN {clean} q ON s.record_id = q.record_id LEFT JOIN {pauses} p ON s.record_id = p.record_id
    LEFT JOIN {burden} b ON s.record_id = b.record_id LEFT JOIN {extremes} x ON s.record_id = x.record_id LEFT JOIN {day_night} n ON s.record_id = n.record_id LEFT JOIN {sleep_wake} w ON s.record_id = w.record_id LEFT JOIN {pct} h ON s.record_id = h.record_id
    """
)

#: The head of a report. records: record_id, start, sex, age. Whole days count as hours; device and software are names to print.
header = operator(
    """
    SELECT r.record_id, CASE r.sex WHEN 'M' THEN 'муж.' WHEN 'F' THEN 'жен.' ELSE coalesce(r.sex, '') END AS sex_ru,
           coalesce(concat(cast(r.age as string), CASE WHEN r.age % 10 = 1 AND r.age % 100 <> 11 THEN ' год' WHEN r.age % 10 BETWEEN 2 AND 4 AND r.age % 100 NOT BETWEEN 12 AND 14 THEN ' года' ELSE ' лет' END), '') AS age_ru,
           date_format(r.start, 'dd.MM.yyyy HH:mm') AS begins, date_format(timestampadd(SECOND, s.total_ms div 1000, r.start), 'dd.MM.yyyy HH:mm') AS ends,
           concat(cast(s.total_ms div 3600000 as string), ' ч ', cast(s.total_ms div 60000 % 60 as string), ' мин') AS duration,
           '{device}' AS device, '{software}' AS software, replace(format_number(d.beats, 0), ',', ' ') AS beats
    FROM {records} r JOIN {span} s ON r.record_id = s.record_id JOIN {counted} d ON r.record_id = d.record_id
    """,
    """
    SELECT r.record_id, CASE r.sex WHEN 'M' THEN 'муж.' WHEN 'F' THEN 'жен.' ELSE coalesce(r.sex, '') END AS sex_ru,
           CASE WHEN r.age IS NULL THEN '' ELSE r.age || CASE WHEN r.age % 100 BETWEEN 11 AND 14 THEN ' лет' WHEN r.age % 10 = 1 THEN ' год' WHEN r.age % 10 IN (2, 3, 4) THEN ' года' ELSE ' лет' END END AS age_ru,
           strftime(r.start, '%d.%m.%Y %H:%M') AS begins, strftime(r.start + to_seconds(s.total_ms // 1000), '%d.%m.%Y %H:%M') AS ends,
           (s.total_ms // 3600000) || ' ч ' || (s.total_ms // 60000 % 60) || ' мин' AS duration,
           '{device}' AS device, '{software}' AS software, replace(format('{:,}', CAST(d.beats AS BIGINT)), ',', ' ') AS beats
    FROM {records} r JOIN {span} s ON r.record_id = s.record_id JOIN {counted} d ON r.record_id = d.record_id
    """,
    device="12 отведений, 125 Гц",
    software="pulseforge (проверка разметки)",
)

#: The records' beginnings and patients, which the driver's tables lack (fixed choices)
stand_in_records = operator("SELECT record_id, cast('2024-01-01 08:15:00' as timestamp_ntz) AS start, CASE WHEN record_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 41 + record_id % 30 AS age FROM {beat} GROUP BY record_id", "SELECT record_id, TIMESTAMP '2024-01-01 08:15:00' AS start, CASE WHEN record_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 41 + record_id % 30 AS age FROM {beat} GROUP BY record_id")

#: In which part of the day a family's beats mostly are (three fifths), for a record that starts at an hour of the day
hours_note = operator(
    """
    SELECT record_id, family, CASE WHEN n >= 0.6e0 * total THEN concat('в основном ', part, ' (', cast(cast(round(100e0 * n / total) as bigint) as string), '%)') ELSE 'в течение суток' END AS note
    FROM (SELECT record_id, family, part, n, sum(n) OVER (PARTITION BY record_id, family) AS total, row_number() OVER (PARTITION BY record_id, family ORDER BY n DESC, part) AS r
          FROM (SELECT record_id, family, CASE WHEN (h + {start_hour}) % 24 < 6 THEN 'ночью' WHEN (h + {start_hour}) % 24 < 12 THEN 'утром' WHEN (h + {start_hour}) % 24 < 18 THEN 'днём' ELSE 'вечером' END AS part, sum(n) AS n
                FROM {hours} GROUP BY record_id, family, CASE WHEN (h + {start_hour}) % 24 < 6 THEN 'ночью' WHEN (h + {start_hour}) % 24 < 12 THEN 'утром' WHEN (h + {start_hour}) % 24 < 18 THEN 'днём' ELSE 'вечером' END) a) b
    WHERE r = 1 AND total > 0
    """,
    start_hour=8,
)

#: Verdicts as the report names them
VERDICTS = {
    "likely": "вероятная",
    "uncertain": "спорная",
    "double-count": "двойной счёт",
    "on-wave": "не на QRS",
    "noisy": "в помехе",
    "narrow": "узкий QRS",
    "too-wide": "ширина вне физиологичной",
    "not-premature": "не преждевременная",
    "on-schedule": "по синусовому графику",
    "sinus-shape": "синусовая морфология",
    "manual": "ручная",
    "manual-N": "ручная: N",
    "manual-X": "ручная: артефакт",
}
NAMED = " ".join(f"WHEN '{v}' THEN '{text}'" for v, text in VERDICTS.items())
verdict_ru = operator(f"SELECT record_id, k, verdict, CASE verdict {NAMED} END AS verdict_ru FROM {{audit}}")

#: Why most of a family's V labels were rejected; of equal reasons the first in the record
top_reason = operator(
    f"""
    SELECT record_id, family, CASE verdict {NAMED} ELSE verdict END AS reason
    FROM (SELECT record_id, family, verdict, row_number() OVER (PARTITION BY record_id, family ORDER BY sum(n) DESC, min(first_k)) AS r FROM {{summary}}
          WHERE label = 'V' AND verdict NOT IN ('likely', 'uncertain', 'manual', 'N', 'manual-N') GROUP BY record_id, family, verdict) a WHERE r = 1
    """
)

verdict_text = operator(
    """
    SELECT s.record_id, s.family, CASE WHEN by_hand IS NOT NULL THEN concat('врач: ', by_hand) WHEN v = 0 AND s.s > 0 THEN concat('форма синусовая; ', cast(s.s as string), ' ранних (НЖЭС) по времени') WHEN v = 0 THEN 'синусовая форма'
           WHEN kept_v = v THEN concat('ЖЭС: аудит подтверждает все ', cast(v as string)) WHEN kept_v = 0 THEN concat('не ЖЭС: все ', cast(v as string), ' метки V отклонены (', coalesce(reason, ''), ')')
           ELSE concat('ЖЭС? подтверждено ', cast(kept_v as string), ' из ', cast(v as string), ', отклонено ', cast(rejected_v as string)) END AS text
    FROM {score} s LEFT JOIN {reasons} r ON s.record_id = r.record_id AND s.family = r.family
    """
)

#: A beat's features beside what they are held against: sinus width, height of sinus beats, rhythm before
feat_rows = operator(
    "SELECT record_id, k, width_ms, round(width_ms / width_ratio, 2) AS sinus_ms, round(100 * amp_ratio, 2) AS amp_pct, rr_pre, round(rr_pre / prematurity, 2) AS rhythm_ms, round(100 * prematurity, 2) AS premature_pct, noise_ratio FROM {features} WHERE width_ratio > 0 AND prematurity > 0"
)

hr_ticks = operator("SELECT record_id, lo + 10 AS low, round((lo + hi) / 20) * 10 AS mid, hi - 10 AS high FROM {bounds}")

#: Zoom to a factor around a time, and a range within a record
clamp_range = operator(
    "SELECT record_id, id, greatest(0, least(total_ms - span, t_ms + dur_ms div 2 - span div 2)) AS a, least(total_ms, greatest(0, least(total_ms - span, t_ms + dur_ms div 2 - span div 2)) + span) AS b FROM (SELECT e.record_id, e.id, e.t_ms, e.dur_ms, s.total_ms, greatest(10000, least(120000, e.dur_ms * 3)) AS span FROM {episode} e JOIN {span} s ON e.record_id = s.record_id) x"
)

wave_points = operator("SELECT cast(0 as bigint) AS record_id, k, p, x AS v FROM {points}")
wave_family = operator("SELECT DISTINCT cast(0 as bigint) AS record_id, k, cast(label as bigint) AS family FROM {points}")
