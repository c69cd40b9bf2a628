"""Audit of ectopic labels: a cascade of rules over features of each labelled beat, then the evidence of its family of shapes
and of the sinus schedule. A label still counts as ectopic with verdict likely, uncertain or manual."""

from __future__ import annotations

from .rhythm import beside, middle
from .sql import operator

KEPT = "('likely', 'uncertain', 'manual')"

#: Thresholds apply to features rounded as they are stored. Texts are fixed values that reports quote.
audit_verdict = operator(
    """
    SELECT record_id, k, t_ms, label, rr_pre, rr_post, amp_ratio, noise_ratio, width_ms, width_ratio, prematurity, verdict,
           CASE verdict WHEN 'double-count' THEN 0.95e0 WHEN 'on-wave' THEN 0.9e0 WHEN 'noisy' THEN 0.5e0 WHEN 'too-wide' THEN 0.85e0 WHEN 'not-premature' THEN 0.7e0
                WHEN 'narrow' THEN 0.7e0 WHEN 'uncertain' THEN CASE WHEN edge THEN 0.3e0 ELSE 0.5e0 END ELSE CASE WHEN label = 'V' AND noise_ratio > 1.5e0 THEN 0.6e0 ELSE 0.8e0 END END AS confidence,
           CASE WHEN edge THEN 'edge of record'
                WHEN verdict = 'double-count' THEN concat('RR ', cast(rr_pre as string), ' мс: двойной счёт одного QRS')
                WHEN verdict = 'on-wave' THEN concat('амплитуда ', cast(cast(round(amp_ratio * 100) as bigint) as string), '% от соседних N: метка не на QRS')
                WHEN verdict = 'noisy' AND win_noise >= 0.5e0 THEN concat('помеха в этом окне (', cast(cast(round(win_noise * 100) as bigint) as string), '%)')
                WHEN verdict = 'noisy' AND noise_mv > 0.25e0 * ref_amp THEN concat('шум ', cast(cast(round(noise_mv / ref_amp * 100) as bigint) as string), '% от амплитуды QRS: форма не читается')
                WHEN verdict = 'noisy' AND noise_ratio >= 4 THEN 'сильный шум в этом месте'
                WHEN verdict = 'noisy' THEN 'заметный шум в этом месте'
                WHEN verdict = 'too-wide' THEN concat('ширина ', cast(cast(round(width_ms) as bigint) as string), ' мс: столько не длится ни один QRS')
                WHEN verdict = 'not-premature' THEN concat('не преждевременная: RR ', cast(rr_pre as string), ' мс, ритм до неё ', cast(cast(round(rr_pre / prematurity) as bigint) as string))
                WHEN verdict = 'narrow' THEN concat('QRS ', cast(cast(round(width_ms) as bigint) as string), ' мс, как синусовый (', cast(cast(round(sinus_width) as bigint) as string), ')')
                WHEN label = 'V' AND verdict = 'uncertain' THEN concat('QRS ', cast(cast(round(width_ms) as bigint) as string), ' мс при синусовом ', cast(cast(round(sinus_width) as bigint) as string), ': пограничная ширина')
                WHEN label = 'V' THEN concat('QRS ', cast(cast(round(width_ms) as bigint) as string), ' мс при синусовом ', cast(cast(round(sinus_width) as bigint) as string), CASE WHEN noise_ratio > 1.5e0 THEN '; умеренный шум в этом месте' ELSE '' END)
                WHEN prematurity > 0 THEN concat('преждевременная: RR ', cast(rr_pre as string), ' мс при ритме ', cast(cast(round(rr_pre / prematurity) as bigint) as string))
                ELSE 'узкий QRS' END AS reason
    FROM (SELECT f.*, CASE WHEN edge THEN 'uncertain' WHEN rr_pre < 300 THEN 'double-count' WHEN amp_ratio < 0.5e0 THEN 'on-wave'
                 WHEN noise_ratio > 2.5e0 OR win_noise >= 0.5e0 OR noise_mv > 0.25e0 * ref_amp THEN 'noisy'
                 WHEN width_ms > 240 THEN 'too-wide' WHEN prematurity > 0.9e0 THEN 'not-premature'
                 WHEN label = 'V' AND width_ratio >= 1.4e0 THEN 'likely' WHEN label = 'V' AND width_ratio < 1.1e0 THEN 'narrow' WHEN label = 'V' THEN 'uncertain' ELSE 'likely' END AS verdict
          FROM {features} f) a
    """
)

#: family: (record_id, k, label, family) of every beat; a family below 10 beats gives fractions but changes nothing.
family_evidence = operator(
    """
    SELECT a.record_id, a.k, a.t_ms, a.label, f.family, round(f.n_frac, 3) AS family_n_frac, a.verdict AS before,
           CASE WHEN size >= 10 AND a.label = 'V' AND a.verdict IN ('likely', 'uncertain', 'narrow') AND n_frac > 0.9e0 THEN 'sinus-shape'
                WHEN size >= 10 AND a.label = 'V' AND a.verdict = 'uncertain' AND n_frac < 0.2e0 THEN 'likely'
                WHEN size >= 10 AND a.label = 'V' AND a.verdict = 'narrow' AND n_frac < 0.2e0 THEN 'uncertain'
                WHEN size >= 10 AND a.label = 'S' AND a.verdict = 'likely' AND v_frac > 0.5e0 THEN 'uncertain' ELSE a.verdict END AS verdict,
           CASE WHEN size >= 10 AND a.label = 'V' AND a.verdict IN ('likely', 'uncertain', 'narrow') AND n_frac > 0.9e0 THEN 0.85e0
                WHEN size >= 10 AND a.label = 'V' AND a.verdict = 'uncertain' AND n_frac < 0.2e0 THEN 0.8e0
                WHEN size >= 10 AND a.label = 'V' AND a.verdict = 'narrow' AND n_frac < 0.2e0 THEN 0.5e0
                WHEN size >= 10 AND a.label = 'S' AND a.verdict = 'likely' AND v_frac > 0.5e0 THEN 0.5e0 ELSE a.confidence END AS confidence
    FROM {audit} a
    LEFT JOIN (SELECT b.record_id, b.k, b.family, size, n_frac, v_frac FROM {family} b
               JOIN (SELECT record_id, family, count(*) AS size, avg(CASE WHEN label = 'N' THEN 1e0 ELSE 0e0 END) AS n_frac, avg(CASE WHEN label = 'V' THEN 1e0 ELSE 0e0 END) AS v_frac
                     FROM {family} WHERE family >= 0 GROUP BY record_id, family) s ON b.record_id = s.record_id AND b.family = s.family) f
    ON a.record_id = f.record_id AND a.k = f.k
    """
)

#: Whether a beat comes on time by the sinus schedule: a whole number of median N-N intervals (of the last five) after the last N.
on_time = operator(
    f"""
    SELECT record_id, k, t_ms, label, coalesce(abs(gap - greatest(1, cycles) * median) <= 0.1e0 * median, false) AS on_time
    FROM (SELECT b.record_id, b.k, b.t_ms, b.label, s.median, cast(b.t_ms - s.t_ms as double) AS gap, bround((b.t_ms - s.t_ms) / s.median, 0) AS cycles
          FROM (SELECT record_id, k, t_ms, label, max(CASE WHEN label = 'N' THEN k END) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM {{rr}}) b
          LEFT JOIN (SELECT record_id, k, t_ms, {middle('v')} AS median
                     FROM (SELECT record_id, k, t_ms, sort_array(array_compact({beside('v', 1, 5)})) AS v
                           FROM (SELECT record_id, k, t_ms, CASE WHEN label = 'N' AND next_label = 'N' THEN cast(rr as double) END AS v FROM {{rr}}) x) y) s
          ON b.record_id = s.record_id AND b.j = s.k) y
    """,
    """
    SELECT record_id, k, t_ms, label, coalesce(abs(gap - greatest(1, cycles) * median) <= 0.1e0 * median, false) AS on_time
    FROM (SELECT b.record_id, b.k, b.t_ms, b.label, s.median, cast(b.t_ms - s.t_ms as double) AS gap, round_even((b.t_ms - s.t_ms) / s.median, 0) AS cycles
          FROM (SELECT record_id, k, t_ms, label, max(CASE WHEN label = 'N' THEN k END) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM {rr}) b
          LEFT JOIN (SELECT record_id, k, t_ms, quantile_cont(v, 0.5) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS median
                     FROM (SELECT record_id, k, t_ms, CASE WHEN label = 'N' AND next_label = 'N' THEN cast(rr as double) END AS v FROM {rr}) x) s
          ON b.record_id = s.record_id AND b.j = s.k) y
    """,
)

#: A kept label on time whose neighbour before is rejected is rejected as on schedule, which may reject the next one. Along
#: audited beats in a row, all that are not open to this keep their state, and each open one takes that of the last of those.
schedule_evidence = operator(
    """
    SELECT record_id, k, t_ms, label, family, family_n_frac, verdict AS before, CASE WHEN open AND state % 2 = 1 THEN 'on-schedule' ELSE verdict END AS verdict, CASE WHEN open AND state % 2 = 1 THEN 0.8e0 ELSE confidence END AS confidence
    FROM (SELECT *, max(CASE WHEN NOT open THEN 2 * k + CASE WHEN verdict IN ('likely', 'uncertain', 'manual') THEN 0 ELSE 1 END END) OVER (PARTITION BY record_id, island ORDER BY k ROWS UNBOUNDED PRECEDING) AS state
          FROM (SELECT a.*, o.on_time AND a.verdict IN ('likely', 'uncertain') AS open, a.k - row_number() OVER (PARTITION BY a.record_id ORDER BY a.k) AS island
                FROM {audit} a JOIN {on_time} o ON a.record_id = o.record_id AND a.k = o.k) x) y
    """
)

#: Features need samples; these stand in for them where only beats are given (fixed functions of event_id). which: of audited beats, or of all (true)
stand_in_features = operator(
    """
    SELECT b.record_id, b.k, b.t_ms, b.label, b.rr_pre, b.rr_post, b.k = 0 AS edge, (30 + event_id % 100) / 100e0 AS amp_ratio, (event_id * 7 % 50) / 10e0 AS noise_ratio, (event_id % 40) / 100e0 AS noise_mv,
           1e0 AS ref_amp, (event_id * 3 % 11) / 20e0 AS win_noise, cast(60 + event_id * 13 % 220 as double) AS width_ms, 97e0 AS sinus_width, round((60 + event_id * 13 % 220) / 97e0, 2) AS width_ratio,
           round(b.rr_pre / r.rhythm + 1e-9, 2) AS prematurity
    FROM (SELECT record_id, k, t_ms, label, event_id, t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY k) AS rr_pre, lead(t_ms) OVER (PARTITION BY record_id ORDER BY k) - t_ms AS rr_post FROM {beat}) b
    JOIN {rhythm} r ON b.record_id = r.record_id AND b.k = r.k WHERE {which}
    """,
    which="b.label <> 'N'",
)
stand_in_families = operator("SELECT record_id, k, t_ms, label, CASE WHEN event_id % 29 = 0 THEN -1 ELSE cast(CASE label WHEN 'N' THEN event_id % 3 WHEN 'V' THEN 2 + event_id % 3 ELSE event_id % 5 END as bigint) END AS family FROM {beat}")
