"""Records made of the tables of the data folder, which hold no ECG of their own.

B1: every user of `events` is a record, whose events are beats. B2: stretches of events by event_id are long records, of four
lengths, so that more data means more records, not longer ones. B3: event values are the samples of a B2 record, with a lead
per event type. B5: events with certain numbers in props are reviewer's edits of B2. Every event is a beat of one record.
"""

from __future__ import annotations

from ..operators.sql import Table, operator

EVENTS = Table("events")

#: Milliseconds of event time that make one of record time in B1; the median interval is then about 800 ms.
B1_DIVISOR = 33000

#: Of each 10 000 events, the first 7500 are a record (over two hours), the next 1500, 700 and 300 are others.
LONG_RECORD = "event_id div 10000 * 4 + CASE WHEN event_id % 10000 < 7500 THEN 0 WHEN event_id % 10000 < 9000 THEN 1 WHEN event_id % 10000 < 9700 THEN 2 ELSE 3 END"

_raw = operator(f"SELECT event_id, user_id, event_type, value, prop(props) AS pk, millis(ts) AS ms, {LONG_RECORD} AS long_id FROM {{events}}").on(events=EVENTS)

# Events (record_id, slot, event_id, regular, ...) as beats: an event whose slot is taken moves to the next free ms, and
# regular ms are added from beat to beat.
_BEATS = """
    SELECT record_id, k, k * (1 + regular) + max(slot - k) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_ms,
           CASE event_type WHEN 'purchase' THEN 'V' WHEN 'error' THEN 'S' ELSE 'N' END AS label, event_id, value, pk
    FROM (SELECT *, cast(row_number() OVER (PARTITION BY record_id ORDER BY slot, event_id) - 1 as bigint) AS k FROM ({slots}) a) b
"""

many_records = operator(_BEATS.replace("{slots}", "SELECT user_id AS record_id, event_id, event_type, value, pk, 0 AS regular, (ms - min(ms) OVER (PARTITION BY user_id)) div {divisor} AS slot FROM {raw}"), divisor=B1_DIVISOR).on(raw=_raw)

#: A second a beat on average: irregular throughout, or in records of odd number 700 ms and an irregular rest of 300.
long_records = operator(
    _BEATS.replace(
        "{slots}",
        """
        SELECT long_id AS record_id, event_id, event_type, value, pk, long_id % 2 * 700 AS regular, (ms - lo) * n * (1000 - long_id % 2 * 700) div greatest(hi - lo, 1) AS slot
        FROM (SELECT *, min(ms) OVER (PARTITION BY long_id) AS lo, max(ms) OVER (PARTITION BY long_id) AS hi, count(*) OVER (PARTITION BY long_id) AS n FROM {raw}) r
        """,
    )
).on(raw=_raw)

samples = operator(
    """
    SELECT long_id AS record_id, event_type AS lead, cast(row_number() OVER (PARTITION BY long_id, event_type ORDER BY ms, event_id) - 1 as bigint) AS i, value AS x
    FROM {raw}
    """
).on(raw=_raw)
