"""The tables of the data folder as records, where events are many or close."""

import pytest

from pulseforge.operators import rhythm
from pulseforge.sources import bindings


@pytest.mark.parametrize("apart, n", [(0, 40), (1, 300), (799, 50)])
def test_close_events_are_all_beats_of_a_long_record(spark, tmp_path, apart, n):
    """Events that share a ms in threes."""
    rows = [(i, 1_700_000_000_000 + i // 3 * apart, i % 5, ("click", "purchase", "error")[i % 3], 1.0, '{"k": 1}') for i in range(n)]
    made = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "cast(timestamp_millis(ms) as timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    beats = bindings.long_records.frame(spark, str(tmp_path)).orderBy("k").collect()
    assert [b["k"] for b in beats] == list(range(n)) and [b["event_id"] for b in beats] == list(range(n))
    times = [b["t_ms"] for b in beats]
    assert times[0] == 0 and all(a < b for a, b in zip(times, times[1:]))
    if apart:
        assert abs(times[-1] - n * 1000) <= 2
    assert rhythm.rr.on(beat=bindings.long_records).frame(spark, str(tmp_path)).filter("rr > 0").count() == n - 1


@pytest.mark.parametrize("binding", ["many_records", "long_records"])
def test_every_event_is_a_beat_of_one_record(spark, binding):
    """Times rise within a record, and no event is left out."""
    rows = getattr(bindings, binding).frame(spark, "/root/testdata/sf0.01").select("record_id", "k", "t_ms", "event_id").orderBy("record_id", "k").collect()
    assert sorted(r["event_id"] for r in rows) == list(range(10_000))
    assert all(a["record_id"] < b["record_id"] and b["k"] == 0 or (a["k"] + 1 == b["k"] and a["t_ms"] < b["t_ms"]) for a, b in zip(rows, rows[1:]))
