"""The conversions of text.py where they are SQL: wall clock, spaced thousands, decimal comma, plural, spans, axis scaling."""

from __future__ import annotations

from ..operators.sql import operator

report_numbers = operator(
    """
    SELECT k, t_ms, date_format(timestampadd(MILLISECOND, t_ms, timestamp_ntz '2024-01-01 08:15:00'), 'HH:mm') AS clk,
           concat(cast(t_ms div 3600000 as string), ':', lpad(cast(t_ms div 60000 % 60 as string), 2, '0'), ':', lpad(cast(t_ms div 1000 % 60 as string), 2, '0')) AS hms,
           regexp_replace(cast(round(t_ms / 1000e0, 1) as string), '([0-9])[.]([0-9])', '$1,$2') AS seconds,
           replace(format_number(t_ms, 0), ',', ' ') AS spaced,
           CASE WHEN k % 10 = 1 AND k % 100 <> 11 THEN 'метка' WHEN k % 10 BETWEEN 2 AND 4 AND k % 100 NOT BETWEEN 12 AND 14 THEN 'метки' ELSE 'меток' END AS plural,
           greatest(300, least(1600, value * 4)) AS rr_y, CASE label WHEN 'V' THEN 1 WHEN 'S' THEN 2 WHEN 'X' THEN 3 ELSE 0 END AS label_code
    FROM {beat}
    """,
    """
    SELECT k, t_ms, strftime(TIMESTAMP '2024-01-01 08:15:00' + to_milliseconds(t_ms), '%H:%M') AS clk,
           concat(t_ms // 3600000, ':', lpad(CAST(t_ms // 60000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(t_ms // 1000 % 60 AS VARCHAR), 2, '0')) AS hms,
           regexp_replace(CAST(round(t_ms / 1000e0, 1) AS VARCHAR), '([0-9])[.]([0-9])', '\\1,\\2') AS seconds,
           replace(format('{:,}', t_ms), ',', ' ') AS spaced,
           CASE WHEN k % 10 = 1 AND k % 100 <> 11 THEN 'метка' WHEN k % 10 BETWEEN 2 AND 4 AND k % 100 NOT BETWEEN 12 AND 14 THEN 'метки' ELSE 'меток' END AS plural,
           greatest(300, least(1600, value * 4)) AS rr_y, CASE label WHEN 'V' THEN 1 WHEN 'S' THEN 2 WHEN 'X' THEN 3 ELSE 0 END AS label_code
    FROM {beat}
    """,
)
