"""Counts, criteria and hourly tables of a record."""

from __future__ import annotations

from .sql import operator

KEPT = "verdict IN ('likely', 'uncertain', 'manual')"

verdict_counts = operator("SELECT record_id, label, verdict, count(*) AS n FROM {audit} GROUP BY record_id, label, verdict")
beat_totals = operator("SELECT record_id, count(*) AS beats FROM {beat} GROUP BY record_id")
device_counts = operator("SELECT record_id, count_if(label = 'N') AS n, count_if(label = 'V') AS v, count_if(label = 'S') AS s FROM {beat} GROUP BY record_id")
audited_counts = operator(f"SELECT record_id, count_if(label = 'V' AND {KEPT}) AS v, count_if(label = 'V' AND verdict IN ('likely', 'manual')) AS v_likely, count_if(label = 'S' AND {KEPT}) AS s FROM {{audit}} GROUP BY record_id")
clean_pct = operator("SELECT record_id, round(avg(CASE WHEN noise < 0.5e0 THEN 100e0 ELSE 0e0 END), 2) AS clean_pct FROM {noise} GROUP BY record_id")
pauses = operator(
    "SELECT b.record_id, count_if(b.rr > 2000) AS device, max(coalesce(p.n, 0)) AS real FROM {rr} b LEFT JOIN (SELECT record_id, count(*) AS n FROM {episode} WHERE kind = 'pause' AND verdict <> 'artifact' GROUP BY record_id) p ON b.record_id = p.record_id GROUP BY b.record_id"
)
v_burden = operator(f"SELECT b.record_id, round(100e0 * coalesce(max(a.v), 0) / count(*), 4) AS v_burden FROM {{beat}} b LEFT JOIN (SELECT record_id, count(*) AS v FROM {{audit}} WHERE label = 'V' AND {KEPT} GROUP BY record_id) a ON b.record_id = a.record_id GROUP BY b.record_id")
morphologies = operator(
    f"SELECT record_id, family, count(*) AS n, cast(row_number() OVER (PARTITION BY record_id ORDER BY count(*) DESC, family DESC) as bigint) AS place FROM {{audit}} WHERE label = 'V' AND {KEPT} AND family >= 0 GROUP BY record_id, family HAVING count(*) >= 3"
)
vt_runs = operator(
    "SELECT record_id, count_if(n >= 4 AND fast) AS vt, count_if(n >= 3 AND fast) AS nsvt3 FROM (SELECT record_id, k1 - k0 + 1 AS n, 60000e0 * (k1 - k0) / greatest(1, dur_ms) > 100 AS fast FROM {episode} WHERE kind = 'v-run' AND verdict <> 'artifact') a GROUP BY record_id"
)
criteria = operator(
    """
    SELECT b.record_id, k.key, CASE k.key WHEN 'pause' THEN coalesce(p.longest, 0) >= 2500 WHEN 'vt' THEN CASE WHEN v.vt > 0 THEN true WHEN v.nsvt3 > 0 THEN cast(NULL as boolean) ELSE false END WHEN 'pvc' THEN b.v_burden >= 10 ELSE cast(NULL as boolean) END AS met,
           CASE k.key WHEN 'pause' THEN round(coalesce(p.longest, 0) / 1000e0, 1) WHEN 'vt' THEN cast(coalesce(v.vt, 0) as double) WHEN 'pvc' THEN round(b.v_burden, 2) WHEN 'af' THEN cast(coalesce(f.irregular, 0) as double) END AS value
    FROM {burden} b CROSS JOIN (SELECT 'pause' AS key UNION ALL SELECT 'vt' UNION ALL SELECT 'pvc' UNION ALL SELECT 'af' UNION ALL SELECT 'avb') k
    LEFT JOIN (SELECT record_id, max(dur_ms) AS longest FROM {episode} WHERE kind = 'pause' AND verdict <> 'artifact' GROUP BY record_id) p ON b.record_id = p.record_id
    LEFT JOIN {vt} v ON b.record_id = v.record_id LEFT JOIN {af} f ON b.record_id = f.record_id
    """
)
density_class = operator(
    "SELECT record_id, v_burden, CASE WHEN v_burden < 0.1e0 THEN 'единичная' WHEN v_burden < 1 THEN 'редкая' WHEN v_burden < 10 THEN 'умеренно частая' WHEN v_burden < 20 THEN 'частая' ELSE 'очень частая' END AS density FROM {burden}"
)
circadian_type = operator(
    f"""
    SELECT m.record_id, CASE WHEN beats = 0 THEN '' WHEN r > 2 THEN 'ночной' WHEN r < 0.5e0 THEN 'дневной' ELSE 'смешанный' END AS circadian
    FROM (SELECT m.record_id, sum(n) AS beats, (sum(CASE WHEN asleep THEN n ELSE 0 END) / cast(greatest(1, count_if(asleep)) as double)) / greatest(1e-9, sum(CASE WHEN asleep THEN 0 ELSE n END) / cast(greatest(1, count_if(NOT asleep)) as double)) AS r
          FROM (SELECT s.record_id, s.m, s.asleep, coalesce(c.n, 0) AS n FROM {{minutes}} s LEFT JOIN (SELECT record_id, t_ms div 60000 AS m, count(*) AS n FROM {{audit}} WHERE label = '{{label}}' AND {KEPT} GROUP BY record_id, t_ms div 60000) c
                ON s.record_id = c.record_id AND s.m = c.m) m GROUP BY m.record_id) m
    """,
    label="V",
)

#: Calendar hours of a record that starts start_ms after midnight: the first may be short, those under a minute are left out.
hour_spine = operator(
    """
    SELECT record_id, i, greatest(0, lo) AS lo, least(lo + 3600000, total_ms + 1) AS hi
    FROM (SELECT record_id, i, total_ms, i * 3600000 - {start_ms} % 3600000 AS lo FROM (SELECT record_id, total_ms, explode(sequence(cast(0 as bigint), (total_ms + {start_ms} % 3600000) div 3600000)) AS i FROM {span}) a) b
    WHERE least(lo + 3600000, total_ms + 1) - greatest(0, lo) >= 60000
    """,
    start_ms=29700000,
)
#: hours: those of hour_spine with the same start_ms
hourly = operator(
    f"""
    SELECT h.record_id, h.i, h.hi - h.lo < 3540000 AS partial, cast(bround((h.hi - h.lo) / 60000e0, 0) as bigint) AS minutes, coalesce(b.beats, 0) AS beats, m.hr_min, m.hr_mean, m.hr_max, coalesce(a.v, 0) AS v, coalesce(a.s, 0) AS s,
           coalesce(e.pairs, 0) AS pairs, coalesce(e.runs, 0) AS runs, coalesce(e.s_runs, 0) AS s_runs, coalesce(e.pauses, 0) AS pauses, coalesce(n.noise_pct, 0e0) AS noise_pct, coalesce(m.asleep > 0.5e0, false) AS sleep
    FROM {{hours}} h
    LEFT JOIN (SELECT record_id, (t_ms + {{start_ms}} % 3600000) div 3600000 AS i, count(*) AS beats FROM {{beat}} GROUP BY record_id, (t_ms + {{start_ms}} % 3600000) div 3600000) b ON h.record_id = b.record_id AND h.i = b.i
    LEFT JOIN (SELECT h.record_id, h.i, bround(min(m.hr), 0) AS hr_min, bround(round(avg(m.hr), 6), 0) AS hr_mean, bround(max(m.hr), 0) AS hr_max, avg(CASE WHEN m.asleep THEN 1e0 ELSE 0e0 END) AS asleep
               FROM (SELECT record_id, i, explode(sequence(lo div 60000, (hi + 59999) div 60000 - 1)) AS m FROM {{hours}}) h JOIN {{minutes}} m ON h.record_id = m.record_id AND h.m = m.m GROUP BY h.record_id, h.i) m ON h.record_id = m.record_id AND h.i = m.i
    LEFT JOIN (SELECT record_id, (t_ms + {{start_ms}} % 3600000) div 3600000 AS i, count_if(label = 'V') AS v, count_if(label = 'S') AS s FROM {{audit}} WHERE {KEPT} GROUP BY record_id, (t_ms + {{start_ms}} % 3600000) div 3600000) a ON h.record_id = a.record_id AND h.i = a.i
    LEFT JOIN (SELECT record_id, (t_ms + {{start_ms}} % 3600000) div 3600000 AS i, count_if(kind = 'v-run' AND k1 - k0 = 1) AS pairs, count_if(kind = 'v-run' AND k1 - k0 >= 2) AS runs, count_if(kind = 's-run') AS s_runs, count_if(kind = 'pause') AS pauses
               FROM {{episode}} WHERE verdict <> 'artifact' GROUP BY record_id, (t_ms + {{start_ms}} % 3600000) div 3600000) e ON h.record_id = e.record_id AND h.i = e.i
    LEFT JOIN (SELECT h.record_id, h.i, round(avg(CASE WHEN noise >= 0.5e0 THEN 100e0 ELSE 0e0 END), 1) AS noise_pct FROM (SELECT record_id, i, explode(sequence(lo div 2000, hi div 2000 - 1)) AS w FROM {{hours}}) h JOIN {{noise}} n ON h.record_id = n.record_id AND h.w = n.w GROUP BY h.record_id, h.i) n ON h.record_id = n.record_id AND h.i = n.i
    """,
    start_ms=29700000,
)
kept_in = operator(f"SELECT e.record_id, e.kind, count(*) AS n FROM (SELECT record_id, kind, explode(sequence(k0, k1)) AS k FROM {{episode}} WHERE verdict <> 'artifact' AND kind IN ('v-run', 's-run')) e JOIN {{audit}} a ON e.record_id = a.record_id AND e.k = a.k WHERE a.{KEPT} GROUP BY e.record_id, e.kind")

#: Strips to print: the main rhythm, extremes of the rate, the longest pause, the first runs, one beat of each shape, diary entries
auto_strips = operator(
    f"""
    SELECT record_id, id, kind, greatest(0, least(total_ms - cast(dur_s * 1000 as bigint), centre - cast(dur_s * 500 as bigint))) AS t0_ms, dur_s, caption, beat
    FROM (SELECT record_id, 'sinus' AS id, 'sinus' AS kind, m * 60000 + 30000 AS centre, 7.2e0 AS dur_s, concat('Основной ритм: синусовый, ЧСС ', cast(cast(bround(hr, 0) as bigint) as string), ' уд/мин') AS caption, cast(NULL as bigint) AS beat FROM {{sinus}}
          UNION ALL SELECT h.record_id, 'hr-min', 'hr-min', min_at_ms div 1000 * 1000, 7.2e0, concat('Минимальная ЧСС ', cast(cast(bround(hr_min, 0) as bigint) as string), ' уд/мин', CASE WHEN m.asleep THEN ' (сон)' ELSE '' END), NULL
               FROM {{extremes}} h LEFT JOIN {{minutes}} m ON h.record_id = m.record_id AND m.m = min_at_ms div 60000
          UNION ALL SELECT record_id, 'hr-max', 'hr-max', max_at_ms div 1000 * 1000, 7.2e0, concat('Максимальная ЧСС ', cast(cast(bround(hr_max, 0) as bigint) as string), ' уд/мин'), NULL FROM {{extremes}}
          UNION ALL SELECT record_id, concat('pause-', cast(id as string)), kind, t_ms + dur_ms div 2, 7.2e0, concat('Максимальная пауза ', cast(round(dur_ms / 1000e0, 1) as string), ' с'), k0
               FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY dur_ms DESC, id) AS r FROM {{episode}} WHERE kind = 'pause' AND verdict <> 'artifact') p WHERE r = 1
          UNION ALL SELECT record_id, concat('ep-', cast(id as string)), kind, t_ms + dur_ms div 2, CASE WHEN dur_ms <= 4200 THEN 7.2e0 ELSE ceil(dur_ms / 1000e0 + 3) END, title, k0
               FROM (SELECT *, row_number() OVER (PARTITION BY record_id, kind ORDER BY id) AS r FROM {{episode}} WHERE kind IN ('v-run', 's-run') AND verdict <> 'artifact') v WHERE r <= CASE kind WHEN 'v-run' THEN 8 ELSE 4 END
          UNION ALL SELECT record_id, concat('pvc-', cast(family as string)), 'pvc', t_ms, 7.2e0, concat('Желудочковая экстрасистола, морфология ', cast(family_place as string), ' (', cast(family_n as string), ' за сутки)'), k FROM {{ranked}} WHERE label = 'V' AND place = 1 AND family_place <= 4
          UNION ALL SELECT record_id, 'sve', 'sve', t_ms, 7.2e0, 'Наджелудочковая экстрасистола', k FROM {{ranked}} WHERE label = 'S' AND label_place = 1
          UNION ALL SELECT record_id, concat('sym-', cast(id as string)), 'symptom', t_ms, 7.2e0, concat('Дневник: ', CASE WHEN text <> '' THEN text ELSE 'симптом' END), NULL FROM {{diary}}) s
    JOIN {{span}} USING (record_id)
    """
)
#: Kept beats by their worth for print: outside runs first, then manual, least noise, most confidence. audit: the effective audits, of
#: the same merged beats as the episodes
strip_rank = operator(
    f"""
    SELECT a.record_id, a.k, a.t_ms, a.label, a.family, m.place AS family_place, m.n AS family_n, r.k IS NOT NULL AS in_run, row_number() OVER (PARTITION BY a.record_id, a.label, a.family ORDER BY CASE WHEN r.k IS NULL THEN 0 ELSE 1 END, CASE WHEN verdict = 'manual' THEN 0 ELSE 1 END, coalesce(a.noise_ratio, 0e0), confidence DESC, a.k) AS place,
           row_number() OVER (PARTITION BY a.record_id, a.label ORDER BY CASE WHEN r.k IS NULL THEN 0 ELSE 1 END, CASE WHEN verdict = 'manual' THEN 0 ELSE 1 END, coalesce(a.noise_ratio, 0e0), confidence DESC, a.k) AS label_place
    FROM {{audit}} a LEFT JOIN {{morphologies}} m ON a.record_id = m.record_id AND a.family = m.family
    LEFT JOIN (SELECT DISTINCT record_id, k FROM (SELECT record_id, explode(sequence(k0, k1)) AS k FROM {{episode}} WHERE kind IN ('v-run', 's-run') AND verdict <> 'artifact') e) r ON a.record_id = r.record_id AND a.k = r.k
    WHERE {KEPT}
    """
)
#: The awake minute whose rate is nearest to the mean and whose noise is low, of the 30 nearest; else the nearest
strip_sinus = operator(
    """
    SELECT record_id, m, hr FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN worst < 0.15e0 THEN 0 ELSE 1 END, r) AS pick
    FROM (SELECT c.record_id, c.m, c.hr, c.r, max(n.noise) AS worst FROM (SELECT m.record_id, m.m, m.hr, row_number() OVER (PARTITION BY m.record_id ORDER BY round(abs(m.hr - bround(h.hr, 0)), 6), m.m) AS r FROM {minutes} m JOIN {mean} h ON m.record_id = h.record_id WHERE m.hr IS NOT NULL AND NOT m.asleep) c
          LEFT JOIN {noise} n ON c.record_id = n.record_id AND n.w >= c.m * 30 AND n.w < c.m * 30 + 30 WHERE c.r <= 30 GROUP BY c.record_id, c.m, c.hr, c.r) x) y WHERE pick = 1
    """
)

#: Views of the families: members by hour, labels set by hand, pages of members
templates_list = operator(
    """
    SELECT f.record_id, f.family, count(*) AS n, count_if(f.label = 'N') AS n_device, count_if(f.label = 'V') AS v_device, count_if(f.label = 'S') AS s_device, count(l.label) AS by_hand, min(f.k) AS first_k
    FROM {family} f LEFT JOIN {labels} l ON f.record_id = l.record_id AND f.t_ms = l.t_ms WHERE f.family >= 0 GROUP BY f.record_id, f.family
    """
)
template_hours = operator(
    """
    SELECT s.record_id, s.family, s.h, coalesce(c.n, 0) AS n
    FROM (SELECT f.record_id, f.family, explode(sequence(cast(0 as bigint), p.total_ms div 3600000)) AS h FROM (SELECT DISTINCT record_id, family FROM {family} WHERE family >= 0) f JOIN {span} p ON f.record_id = p.record_id) s
    LEFT JOIN (SELECT record_id, family, t_ms div 3600000 AS h, count(*) AS n FROM {family} GROUP BY record_id, family, t_ms div 3600000) c ON s.record_id = c.record_id AND s.family = c.family AND s.h = c.h
    """
)
template_beats = operator(
    "SELECT record_id, k, t_ms, label, total FROM (SELECT *, row_number() OVER (PARTITION BY record_id, family ORDER BY k) AS r, count(*) OVER (PARTITION BY record_id, family) AS total FROM {family} WHERE family = {id}) a WHERE r > {offset} AND r <= {offset} + {limit}",
    id=2,
    offset=10,
    limit=100,
)
family_summary = operator(
    """
    SELECT f.record_id, f.family, coalesce(a.verdict, 'N') AS verdict, f.label, count(*) AS n, min(f.k) AS first_k
    FROM {family} f LEFT JOIN {audit} a ON f.record_id = a.record_id AND f.k = a.k WHERE f.family >= 0 GROUP BY f.record_id, f.family, coalesce(a.verdict, 'N'), f.label
    """
)
#: At most about 40 members of each family, evenly through it
family_sample = operator(
    "SELECT record_id, family, k FROM (SELECT record_id, family, k, row_number() OVER (PARTITION BY record_id, family ORDER BY k) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY record_id, family) div 40) AS step FROM {family} WHERE family >= 0) a WHERE r % step = 0 AND r div step < 40"
)
#: The labels set by hand in a family: which one most of them are (of equal ones the first in time), and all with their numbers, in order of time
hand_labels = operator(
    """
    SELECT record_id, family, max(CASE WHEN r = 1 THEN label END) AS label, array_join(transform(array_sort(collect_list(struct(first, label, n))), x -> concat(x.label, ' ', cast(x.n as string))), ' · ') AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id, family ORDER BY n DESC, first) AS r
          FROM (SELECT f.record_id, f.family, l.label, count(*) AS n, min(f.t_ms) AS first FROM {family} f JOIN {labels} l ON f.record_id = l.record_id AND f.t_ms = l.t_ms WHERE f.family >= 0 GROUP BY f.record_id, f.family, l.label) x) y GROUP BY record_id, family
    """,
    """
    SELECT record_id, family, arg_max(label, (n, -first)) AS label, string_agg(label || ' ' || n, ' · ' ORDER BY first) AS text
    FROM (SELECT f.record_id, f.family, l.label, count(*) AS n, min(f.t_ms) AS first FROM {family} f JOIN {labels} l ON l.record_id = f.record_id AND l.t_ms = f.t_ms WHERE f.family >= 0 GROUP BY ALL) GROUP BY ALL
    """,
)
#: Which drawer a family belongs to: by the label that most of its labels by hand have, or by what the audit of the device's labels
#: (audit, before any label by hand) made of its V labels
family_score = operator(
    f"""
    SELECT x.*, h.text AS by_hand, CASE WHEN h.label IS NOT NULL THEN h.label WHEN v > 0.5e0 * n THEN 'V' WHEN s > 0.5e0 * n THEN 'S' ELSE 'N' END AS dominant,
           CASE WHEN h.label = 'V' THEN 'v' WHEN h.label = 'S' THEN 's' WHEN h.label IS NOT NULL THEN 'n' WHEN v >= 3 AND (uncertain_v >= 3 OR (kept_v / cast(greatest(v, 1) as double) >= 0.2e0 AND kept_v / cast(greatest(v, 1) as double) <= 0.8e0)) THEN 'decide'
                WHEN v >= 3 AND kept_v / cast(greatest(v, 1) as double) > 0.8e0 THEN 'v' WHEN v > 0.5e0 * n THEN 'v' WHEN s > 0.5e0 * n THEN 's' ELSE 'n' END AS bucket
    FROM (SELECT f.record_id, f.family, count(*) AS n, count_if(f.label = 'V') AS v, count_if(f.label = 'S') AS s, count_if(a.{KEPT}) AS kept, count_if(a.verdict = 'uncertain') AS uncertain, count_if(a.verdict NOT IN ('likely', 'uncertain', 'manual', 'N', 'manual-N')) AS rejected,
                 count_if(f.label = 'V' AND a.{KEPT}) AS kept_v, count_if(f.label = 'V' AND a.verdict = 'uncertain') AS uncertain_v, count_if(f.label = 'V' AND a.verdict NOT IN ('likely', 'uncertain', 'manual', 'N', 'manual-N')) AS rejected_v
          FROM {{family}} f LEFT JOIN {{audit}} a ON f.record_id = a.record_id AND f.k = a.k WHERE f.family >= 0 GROUP BY f.record_id, f.family) x
    LEFT JOIN {{by_hand}} h ON x.record_id = h.record_id AND x.family = h.family
    """
)
bucket_counts = operator("SELECT record_id, bucket, count(*) AS n FROM {score} GROUP BY record_id, bucket")
in_bucket = operator("SELECT record_id, family, bucket, n, cast(row_number() OVER (PARTITION BY record_id ORDER BY CASE bucket WHEN 'decide' THEN 0 WHEN 'v' THEN 1 WHEN 's' THEN 2 ELSE 3 END, n DESC, family) as bigint) AS place FROM {score}")

#: Sums over minutes of the overview: the device's V labels, and the V and S that the audit kept
bin_sums = operator("SELECT record_id, m div {minutes} AS b, cast(sum(v_device) as bigint) AS v_device, cast(sum(v) as bigint) AS v, cast(sum(s) as bigint) AS s FROM {overview} GROUP BY record_id, m div {minutes}", minutes=10)
hr_bounds = operator("SELECT record_id, greatest(30, floor(min(hr) / 10) * 10 - 10) AS lo, ceil(max(hr) / 10) * 10 + 10 AS hi FROM {minutes} GROUP BY record_id")
night_minutes = operator("SELECT record_id, m FROM {minutes} WHERE ((m * 60000 + {start_ms}) div 3600000) % 24 < 6", start_ms=29700000)
#: The hour with the most kept V, if there is any
peak_hour = operator("SELECT record_id, b AS hour, v FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY v DESC, b) AS r FROM {hours}) a WHERE r = 1 AND v > 0")
#: The figures of the four cards beside the overview. counts: verdicts of effective audits
stats_cards = operator(
    """
    SELECT s.record_id, p.card, p.name, cast(CASE concat(p.card, ' ', p.name) WHEN 'hr mean' THEN bround(m.hr, 0) WHEN 'hr sdnn' THEN round(h.sdnn, 0) WHEN 'hr rmssd' THEN round(h.rmssd, 0) WHEN 'hr sleep' THEN bround(s.sleep, 0) WHEN 'hr wake' THEN bround(s.wake, 0)
           WHEN 'hr min' THEN bround(s.hr_min, 0) WHEN 'hr min_at_s' THEN s.min_at_s WHEN 'hr max' THEN bround(s.hr_max, 0) WHEN 'hr max_at_s' THEN s.max_at_s
           WHEN 'v device' THEN s.device_v WHEN 'v kept' THEN s.kept_v WHEN 'v likely' THEN s.v_likely WHEN 'v uncertain' THEN s.kept_v - s.v_likely WHEN 'v rejected' THEN coalesce(r.v, 0) WHEN 'v percent' THEN round(100e0 * s.kept_v / s.beats, 2) WHEN 'v morphologies' THEN coalesce(f.n, 0)
           WHEN 's device' THEN s.device_s WHEN 's kept' THEN s.kept_s WHEN 's rejected' THEN coalesce(r.s, 0) WHEN 's percent' THEN round(100e0 * s.kept_s / s.beats, 2)
           WHEN 'pauses real' THEN s.pauses_real WHEN 'pauses device' THEN s.pauses_device WHEN 'pauses noise' THEN s.pauses_device - s.pauses_real WHEN 'pauses clean_pct' THEN s.clean_pct WHEN 'pauses edits' THEN e.manual + e.added + e.quality_spans END as double) AS value
    FROM {summary} s CROSS JOIN (SELECT 'hr' AS card, explode(array('mean', 'sdnn', 'rmssd', 'sleep', 'wake', 'min', 'min_at_s', 'max', 'max_at_s')) AS name UNION ALL SELECT 'v', explode(array('device', 'kept', 'likely', 'uncertain', 'rejected', 'percent', 'morphologies'))
                           UNION ALL SELECT 's', explode(array('device', 'kept', 'rejected', 'percent')) UNION ALL SELECT 'pauses', explode(array('real', 'device', 'noise', 'clean_pct', 'edits'))) p
    LEFT JOIN {mean} m ON s.record_id = m.record_id LEFT JOIN {hrv} h ON s.record_id = h.record_id LEFT JOIN {edits} e ON s.record_id = e.record_id LEFT JOIN (SELECT record_id, count(*) AS n FROM {morphologies} GROUP BY record_id) f ON s.record_id = f.record_id
    LEFT JOIN (SELECT record_id, cast(sum(CASE WHEN label = 'V' THEN n ELSE 0 END) as bigint) AS v, cast(sum(CASE WHEN label = 'S' THEN n ELSE 0 END) as bigint) AS s FROM {counts} WHERE verdict NOT IN ('likely', 'uncertain', 'manual') GROUP BY record_id) r ON s.record_id = r.record_id
    """
)
#: What the device counted and what the audit left of it
dumbbell = operator(
    """
    SELECT s.record_id, p.place, p.name, CASE p.place WHEN 0 THEN device_v WHEN 1 THEN device_s WHEN 2 THEN coalesce(v_runs, 0) WHEN 3 THEN coalesce(s_runs, 0) ELSE pauses_device END AS before,
           CASE p.place WHEN 0 THEN kept_v WHEN 1 THEN kept_s WHEN 2 THEN coalesce(v_kept, 0) WHEN 3 THEN coalesce(s_kept, 0) ELSE pauses_real END AS after
    FROM {summary} s CROSS JOIN (SELECT 0 AS place, 'ЖЭС' AS name UNION ALL SELECT 1, 'НЖЭС' UNION ALL SELECT 2, 'залпы ЖЭС' UNION ALL SELECT 3, 'НЖ-залпы' UNION ALL SELECT 4, 'паузы') p
    LEFT JOIN (SELECT record_id, count_if(kind = 'v-run') AS v_runs, count_if(kind = 'v-run' AND verdict <> 'artifact') AS v_kept, count_if(kind = 's-run') AS s_runs, count_if(kind = 's-run' AND verdict <> 'artifact') AS s_kept FROM {episode} GROUP BY record_id) e ON s.record_id = e.record_id
    """
)
