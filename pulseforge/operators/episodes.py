"""Episodes: pauses, runs of ectopic beats, missed beats, noise. Audits are (record_id, k, t_ms, label, verdict, confidence),
noise windows (record_id, w, noise, sharp) of 2 s; k0 and k1 are an episode's first and last beat. Titles are fixed texts."""

from __future__ import annotations

from .rhythm import beside, middle
from .sql import SqlOperator, operator

COLUMNS = "record_id, kind, kind_seq, t_ms, dur_ms, k0, k1, verdict, confidence, title"

#: The highest noise among the windows that an interval touches
noise_at = operator(
    """
    SELECT p.record_id, p.k, coalesce(max(n.noise), 0e0) AS noise FROM (SELECT record_id, k, explode(sequence(t_ms div 2000, (t_ms + rr) div 2000)) AS w FROM {interval}) p
    LEFT JOIN {noise} n ON p.record_id = n.record_id AND p.w = n.w GROUP BY p.record_id, p.k
    """
)

long_intervals = operator("SELECT record_id, k, t_ms, rr FROM {rr} WHERE rr > 2000")

#: checks: (record_id, k, gap_bad, gap_reason, missed), what the signal says of intervals (see signal.interval_checks)
ep_pause = operator(
    """
    SELECT record_id, 'pause' AS kind, 0 AS kind_seq, t_ms, rr AS dur_ms, k AS k0, k + 1 AS k1, CASE WHEN bad THEN 'artifact' ELSE 'review' END AS verdict, CASE WHEN bad THEN 0.9e0 ELSE 0.6e0 END AS confidence,
           concat(CASE WHEN bad THEN '«Пауза» ' ELSE 'Пауза ' END, cast(round(rr / 1000e0, 1) as string), ' с') AS title,
           CASE WHEN gap_bad OR NOT bad THEN gap_reason ELSE concat('помеха в окне ', cast(cast(bround(noise * 100, 0) as bigint) as string), '%') END AS reason
    FROM (SELECT p.record_id, p.k, p.t_ms, p.rr, n.noise, c.gap_reason, coalesce(c.gap_bad, false) AS gap_bad, coalesce(c.gap_bad, false) OR n.noise >= 0.5e0 AS bad
          FROM {interval} p JOIN {noise_at} n ON p.record_id = n.record_id AND p.k = n.k LEFT JOIN {checks} c ON p.record_id = c.record_id AND p.k = c.k) x
    """
)

#: Stands in for checks where only beats are given
stand_in_checks = operator("SELECT record_id, k, k % 17 = 0 AS gap_bad, CASE WHEN k % 17 = 0 THEN 'зашкал АЦП' ELSE 'изолиния' END AS gap_reason, k % 3 > 0 AS missed FROM {interval}")


def rated(text: str) -> SqlOperator:
    """An operator on runs with a rate a minute. Where all beats of a run have one time, by an inserted beat on a device's, Spark says inf, as
    the reference's floats do; so is a sinus rate of intervals of no time. The other engine keeps the text as it is, and fails on such a run."""
    made, span = operator(text), "(max(t_ms) - min(t_ms))"
    shown = f"cast(cast(bround(60000e0 * (count(*) - 1) / {span}, 0) as bigint) as string)"
    finite = f"nullif({span}, 0)"
    made.text = made.text.replace(shown, f"coalesce({shown.replace(span, finite)}, 'inf')").replace(f"/ {span} AS rate", f"/ {finite} AS rate")
    made.text = made.text.replace("cast(cast(bround(rate, 0) as bigint) as string)", "coalesce(cast(cast(bround(rate, 0) as bigint) as string), 'inf')")
    made.text = made.text.replace("rate < 1.15e0 * (60000e0 / median)", "coalesce(rate < 1.15e0 * (60000e0 / nullif(median, 0)), median = 0 AND rate IS NOT NULL)")
    return made


ep_v_run = rated(
    """
    SELECT record_id, 'v-run' AS kind, 1 AS kind_seq, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS dur_ms, min(k) AS k0, max(k) AS k1, CASE WHEN avg(confidence) >= 0.7e0 - 1e-9 THEN 'likely' ELSE 'review' END AS verdict,
           round(avg(confidence), 2) AS confidence,
           concat('ЖЭС ', CASE WHEN count(*) = 2 THEN 'пара' ELSE concat('×', cast(count(*) as string)) END, ', ', cast(cast(bround(60000e0 * (count(*) - 1) / (max(t_ms) - min(t_ms)), 0) as bigint) as string), '/мин') AS title
    FROM (SELECT *, k - row_number() OVER (PARTITION BY record_id ORDER BY k) AS island FROM {audit} WHERE label = 'V' AND verdict IN ('likely', 'uncertain', 'manual')) a
    GROUP BY record_id, island HAVING count(*) >= 2
    """
)

ep_v_run_rejected = rated(
    """
    SELECT record_id, 'v-run' AS kind, 2 AS kind_seq, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS dur_ms, min(k) AS k0, max(k) AS k1, 'artifact' AS verdict, 0.85e0 AS confidence,
           concat('«ЖЭС ×', cast(count(*) as string), ', ', cast(cast(bround(60000e0 * (count(*) - 1) / (max(t_ms) - min(t_ms)), 0) as bigint) as string), '/мин»') AS title
    FROM (SELECT *, k - row_number() OVER (PARTITION BY record_id ORDER BY k) AS island FROM {audit} WHERE label = 'V') a
    GROUP BY record_id, island HAVING count(*) >= 3 AND count_if(verdict IN ('likely', 'uncertain', 'manual')) = 0
    """
)

#: Median N-N interval of the five that end two beats before each beat, as a sinus rate
sinus_before = operator(
    f"SELECT record_id, k, {middle('v')} AS median FROM (SELECT record_id, k, sort_array(array_compact({beside('v', 2, 6)})) AS v FROM (SELECT record_id, k, CASE WHEN label = 'N' AND next_label = 'N' THEN cast(rr as double) END AS v FROM {{rr}}) a) b",
    "SELECT record_id, k, quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS median FROM (SELECT record_id, k, CASE WHEN label = 'N' AND next_label = 'N' THEN cast(rr as double) END AS v FROM {rr}) a",
)

ep_s_run = rated(
    """
    SELECT g.record_id, 's-run' AS kind, 3 AS kind_seq, g.t_ms, g.dur_ms, g.k0, g.k1, CASE WHEN kept < 3 OR rate < 1.15e0 * (60000e0 / median) THEN 'artifact' ELSE 'review' END AS verdict,
           CASE WHEN kept < 3 OR rate < 1.15e0 * (60000e0 / median) THEN 0.8e0 ELSE 0.6e0 END AS confidence,
           concat(CASE WHEN kept < 3 THEN '«НЖЭС ×' WHEN rate < 1.15e0 * (60000e0 / median) THEN '«НЖТ ×' ELSE 'НЖЭС ×' END, cast(n as string), ', ', cast(cast(bround(rate, 0) as bigint) as string), '/мин',
                  CASE WHEN kept < 3 OR rate < 1.15e0 * (60000e0 / median) THEN '»' ELSE '' END) AS title
    FROM (SELECT record_id, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS dur_ms, min(k) AS k0, max(k) AS k1, count(*) AS n, count_if(verdict IN ('likely', 'uncertain', 'manual')) AS kept,
                 60000e0 * (count(*) - 1) / (max(t_ms) - min(t_ms)) AS rate
          FROM (SELECT *, k - row_number() OVER (PARTITION BY record_id ORDER BY k) AS island FROM {audit} WHERE label = 'S') a GROUP BY record_id, island HAVING count(*) >= 3) g
    JOIN {sinus} s ON g.record_id = s.record_id AND g.k0 = s.k
    """
)

#: Intervals that one beat more would split in two; whether a shape is there (hit) is for the signal to say
missed_candidates = operator(
    """
    SELECT r.record_id, r.k, r.t_ms, r.rr FROM {rr} r JOIN {context} c ON r.record_id = c.record_id AND r.k = c.k
    WHERE r.rr >= 900 AND r.rr < 2000 AND r.rr >= 1.6e0 * c.median AND r.rr <= 2.4e0 * c.median
    """
)

ep_missed = operator(
    """
    SELECT p.record_id, 'missed' AS kind, 4 AS kind_seq, p.t_ms, p.rr AS dur_ms, p.k AS k0, p.k + 1 AS k1, 'review' AS verdict, 0.6e0 AS confidence, concat('Пропущен комплекс? RR ', cast(p.rr as string), ' мс') AS title
    FROM {interval} p JOIN {noise_at} n ON p.record_id = n.record_id AND p.k = n.k JOIN {checks} c ON p.record_id = c.record_id AND p.k = c.k WHERE n.noise < 0.35e0 AND c.missed
    """
)

ep_noise = operator(
    """
    SELECT record_id, 'noise' AS kind, 5 AS kind_seq, min(w) * 2000 AS t_ms, (max(w) - min(w) + 1) * 2000 AS dur_ms, cast(NULL as bigint) AS k0, cast(NULL as bigint) AS k1, 'artifact' AS verdict, 0.9e0 AS confidence,
           concat('Помеха ', cast((max(w) - min(w) + 1) * 2 as string), ' с') AS title
    FROM (SELECT record_id, w, w - row_number() OVER (PARTITION BY record_id ORDER BY w) AS island FROM {noise} WHERE sharp >= 0.5e0) a GROUP BY record_id, island HAVING count(*) >= {windows}
    """,
    windows=15,
)

ep_order = operator(
    f"""
    SELECT cast(row_number() OVER (PARTITION BY record_id ORDER BY t_ms, kind_seq, k0) - 1 as bigint) AS id, * FROM (
    SELECT {COLUMNS} FROM {{pause}} UNION ALL SELECT {COLUMNS} FROM {{v_run}} UNION ALL SELECT {COLUMNS} FROM {{v_run_rejected}}
    UNION ALL SELECT {COLUMNS} FROM {{s_run}} UNION ALL SELECT {COLUMNS} FROM {{missed}} UNION ALL SELECT {COLUMNS} FROM {{noise}}) a
    """
)

noise_runs = operator(
    "SELECT record_id, min(w) AS w0, max(w) + 1 AS w1, round(max(noise), 4) AS score FROM (SELECT *, w - row_number() OVER (PARTITION BY record_id ORDER BY w) AS island FROM {noise} WHERE noise >= 0.35e0) a GROUP BY record_id, island"
)

noise_windows = operator("SELECT record_id, w * 2 AS t0, (w + 1) * 2 AS t1, round(noise, 2) AS score FROM {noise} WHERE noise >= {threshold} AND w >= {start_s} div 2 AND w <= ({start_s} + {dur_s}) div 2", threshold="0.35e0", start_s=600, dur_s=900)

#: Noise windows clipped to a view, touching ones joined with their highest score
merge_noise = operator(
    """
    SELECT record_id, min(greatest(t0, {start_s})) AS t0, max(least(t1, {start_s} + {dur_s})) AS t1, max(score) AS score
    FROM (SELECT *, t0 div 2 - row_number() OVER (PARTITION BY record_id ORDER BY t0) AS island FROM {windows} WHERE t1 > {start_s} AND t0 < {start_s} + {dur_s}) a GROUP BY record_id, island
    """,
    start_s=600,
    dur_s=900,
)

#: The next and previous episode, around the ends
step_episode = operator(
    """
    SELECT record_id, id, coalesce(lead(id) OVER (PARTITION BY record_id ORDER BY id), min(id) OVER (PARTITION BY record_id)) AS next_id, coalesce(lag(id) OVER (PARTITION BY record_id ORDER BY id), max(id) OVER (PARTITION BY record_id)) AS previous_id
    FROM {episode}
    """
)

step_beat = operator(
    """
    SELECT record_id, k, coalesce(lead(k) OVER (PARTITION BY record_id ORDER BY k), min(k) OVER (PARTITION BY record_id)) AS next_k, coalesce(lag(k) OVER (PARTITION BY record_id ORDER BY k), max(k) OVER (PARTITION BY record_id)) AS previous_k
    FROM {audit}
    """
)
