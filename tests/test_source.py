"""A signal that tasks read themselves, against the same signal as rows."""

import pytest

from pulseforge.operators import intervals as Q
from pulseforge.operators import morphology as M
from pulseforge.operators import signal as S
from pulseforge.plans import record as P
from pulseforge.sources import synthetic

FS, MV = 125, 0.001747


@pytest.mark.parametrize("samples", [10_000, 450_000])
def test_kernels_on_a_source_give_the_rows_of_stored_samples(spark, monkeypatch, samples):
    monkeypatch.setattr(S, "CHUNK_SAMPLES", samples)
    beats = spark.createDataFrame([(r, k, 400 + 800 * k + 37 * (k * k % 11), "V" if k % 20 == 7 else "N") for r in range(2) for k in range(200 + 90 * r)], "record_id long, k long, t_ms long, label string")
    source, rows = synthetic.source_of(beats, FS, MV), synthetic.signal_of(beats, FS, MV).cache()
    n = beats.groupBy("record_id").agg({"t_ms": "max"}).selectExpr("record_id", "(`max(t_ms)` + 1000) * 125 div 1000 as n_samples")
    gaps = beats.filter("k % 9 = 4").selectExpr("record_id", "k", "t_ms", "cast(2600 as bigint) rr")
    sampled = P.sinus_sampled(beats)
    for made in (
        lambda s: S.window_metrics(s, FS, MV),
        lambda s: S.beat_measures(s, beats, FS, MV, n),
        lambda s: M.beat_windows(s, beats, FS, MV, n),
        lambda s: S.interval_checks(s, gaps, FS, MV, 1.2, 0.012),
        lambda s: Q.qt_hours(s, Q.sinus_beats(beat=beats), FS, MV, n),
        lambda s: P.calibrated(beats, s, FS, MV, n),
        lambda s: S.ecg_window(s, [0, 6], 20, 10, FS, MV, P.calibrated(beats, s, FS, MV, n)),
        lambda s: P.scanned(beats, sampled, s, FS, MV, n).windows,
        lambda s: P.scanned(beats, sampled, s, FS, MV, n).measures,
        lambda s: P.scanned(beats, sampled, s, FS, MV, n).shapes,
    ):
        want = sorted(map(repr, made(rows).collect()))
        assert sorted(map(repr, made(source).collect())) == want and want


def test_no_samples_are_shuffled(spark):
    """What meets the beats of a source are its chunks' rows, which hold no samples."""
    beats = spark.createDataFrame([(0, k, 400 + 800 * k, "N") for k in range(20)], "record_id long, k long, t_ms long, label string")
    plan = S.beat_measures(synthetic.source_of(beats, FS, MV), beats, FS, MV, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "samples array" not in plan and "samples#" not in plan.replace("n_samples#", "")


def test_segments_are_joined_where_they_lie(spark):
    """The vectors of families are shuffled once: a join by record moves the other side alone."""
    from pulseforge.operators.store import laid_out

    rows = spark.range(100).selectExpr("id % 7 as record_id", "id as k").groupBy("record_id").agg({"k": "max"})
    held = laid_out(rows)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and held.count() == 7
    other = spark.range(7).withColumnRenamed("id", "record_id").hint("shuffle_hash")
    plan = held.join(other, "record_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chunks_stay_dealt_and_sampled_beats_are_measured_once(spark):
    """Small rows whose work is large: as many tasks as were asked for, though the chunks lie in as many partitions as a shuffle has by default."""
    beats = spark.createDataFrame([(r, k, 400 + 800 * k, "N") for r in range(9) for k in range(30)], "record_id long, k long, t_ms long, label string")
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        source = synthetic.source_of(beats, FS, MV)
        assert S.window_metrics(source, FS, MV, (1,)).rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism
        plan = P.calibrated(beats, source, FS, MV, 3000)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" not in plan and plan.count("FlatMapGroups") == 1
    finally:
        spark.conf.set(name, before)


def test_leads_drawn_together_are_those_drawn_alone(spark):
    beats = spark.createDataFrame([(0, k, 400 + 797 * k, "V" if k % 3 else "N") for k in range(30)], "record_id long, k long, t_ms long, label string")
    source = synthetic.source_of(beats, FS, MV)
    row = source.chunks.toPandas().iloc[0].to_dict()
    both = source.read(row, (1, 6), 100, 2000)
    assert both.shape == (2, 1900) and (both == [source.read(row, (lead,), 100, 2000)[0] for lead in (1, 6)]).all() and both.any()
