"""The edit log and the cache by record: read, write and read again in place, with writers that meet or fail."""

import pytest
from pyspark.sql import functions as F

from pulseforge.sources.edit_log import ENTRY, EditLog
from pulseforge.sources.exports import cached_records


def held(log):
    s = log.state()
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    spans = [tuple(r) for r in s.quality.orderBy("record_id", "seq").select("record_id", "t0_ms", "t1_ms", "v").collect()]
    return rows(s.labels, "record_id", "t_ms", "label"), rows(s.added, "record_id", "t_ms", "label"), spans, rows(s.events, "record_id", "id", "t_ms", "text"), rows(s.report, "record_id", "report")


def test_edit_log_in_place(spark, tmp_path):
    log = EditLog(spark, f"{tmp_path}/edits")
    assert held(log) == ([], [], [], [], [])
    assert log.append([(1, "label", 800, None, None, "V"), (1, "label", 800, None, None, "S"), (2, "beat", 137, None, None, "V"), (1, "quality", 9000, 12000, None, "noise")]) == 1
    log.append([(1, "event", 500, None, 1, "боль"), (1, "report", None, None, None, "{}"), (1, "quality", 0, 4000, None, "noise"), (1, "quality", 2000, 3000, None, "clean")])
    want = ([(1, 800, "S")], [(2, 137, "V")], [(1, 9000, 12000, "noise"), (1, 0, 4000, "noise"), (1, 2000, 3000, "clean")], [(1, 1, 500, "боль")], [(1, "{}")])
    assert held(log) == want
    assert log.compact() == 3 and held(log) == want and len(log.commits()) == 1
    log.append([(1, "label", 800, None, None, None), (1, "quality", 3900, 9500, None, None), (2, "beat", 137, None, None, "N"), (1, "event", 500, None, 1, None)])
    want = ([], [(2, 137, "N")], [(1, 2000, 3000, "clean")], [], [(1, "{}")])
    assert held(log) == want
    # What a writer left without a marker is nothing; vacuum removes it, and what the compaction stands for.
    spark.createDataFrame([(9, "label", 1, None, None, "V", 0)], ENTRY).write.parquet(f"{tmp_path}/edits/data/lost")
    assert held(EditLog(spark, f"{tmp_path}/edits")) == want
    assert log.vacuum() == 2 + 3 and held(log) == want
    for bad in ([(1, "label", 1, None, None, "Q")], [(1, "other", 1, None, None, None)]):
        with pytest.raises(ValueError):
            log.append(bad)
        with pytest.raises(ValueError):
            log.append(spark.createDataFrame([(*e, 0) for e in bad], ENTRY))
    assert held(log) == want


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Two that saw the same log both write: one after the other; a compaction that saw less gives up."""
    a, b = (EditLog(spark, f"{tmp_path}/edits") for _ in range(2))
    a.append([(1, "label", 1, None, None, "V")])
    seen = a.commits()
    monkeypatch.setattr(b, "commits", lambda: seen)
    assert a.append([(1, "label", 2, None, None, "V")]) == 2
    assert b.append([(1, "label", 3, None, None, "V")]) == 3
    with pytest.raises(RuntimeError):
        b.compact()
    assert held(a)[0] == [(1, t, "V") for t in (1, 2, 3)]


def test_cache_computes_only_what_is_new(spark, tmp_path):
    asked = []

    def make(records):
        asked.append(sorted(r[0] for r in records.collect()))
        return records.filter("record_id <> 3").select("record_id", F.explode(F.sequence(F.lit(1), F.col("record_id"))).alias("x"), F.lit(len(asked)).alias("call"))

    keys = lambda **k: spark.createDataFrame([(int(r[1:]), v) for r, v in k.items()], "record_id long, key string")
    get = lambda k: sorted(tuple(r) for r in cached_records(spark, f"{tmp_path}", "heavy", k, make).collect())
    assert get(keys(r1="a", r2="a", r3="a")) == [(1, 1, 1), (2, 1, 1), (2, 2, 1)]
    assert get(keys(r1="a", r2="a", r3="a")) == [(1, 1, 1), (2, 1, 1), (2, 2, 1)] and asked == [[1, 2, 3]]
    assert get(keys(r1="a", r2="b", r3="a", r4="a")) == [(1, 1, 1), (2, 1, 2), (2, 2, 2), (4, 1, 2), (4, 2, 2), (4, 3, 2), (4, 4, 2)]
    assert get(keys(r2="a")) == [(2, 1, 1), (2, 2, 1)] and asked == [[1, 2, 3], [2, 4]]

    def fails(records):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        cached_records(spark, f"{tmp_path}", "heavy", keys(r5="a"), fails)
    assert get(keys(r5="a")) == [(5, k, 3) for k in range(1, 6)]
