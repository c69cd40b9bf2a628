"""Edits at rest, the verbs that refuse, and calibration against plain medians."""

import numpy as np
import pytest

from pulseforge.operators import edits as E
from pulseforge.operators import signal as S
from pulseforge.plans import record as P
from pulseforge.sources import overrides as O
from pulseforge.sources import synthetic

FS, MV = 125, 0.001747


def test_overrides_come_back(spark, tmp_path):
    none = O.read_overrides(spark, f"{tmp_path}/absent")
    assert all(df.count() == 0 for df in vars(none).values())
    labels = E.latest_labels(log=E.set_label(none.labels.selectExpr("*", "0L AS seq"), 3, 1200, "V"))
    spans = E.set_quality(E.set_quality(none.quality, 3, 9000, 4000, "noise"), 4, 0, 2000, "clean")
    diary = E.add_event(none.events, 4, 500, "  dizzy ")
    report = E.set_report(E.set_report(none.report, 3, '{"a": 0}'), 3, '{"a": "боль"}')
    O.write_overrides(O.Overrides(labels, none.added, spans, diary, report), f"{tmp_path}/kept")
    back = O.read_overrides(spark, f"{tmp_path}/kept")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(back.labels) == [(3, 1200, "V")] and rows(back.added) == []
    assert rows(back.quality.drop("seq")) == [(3, 4000, 9000, "noise"), (4, 0, 2000, "clean")]
    assert rows(back.events) == [(4, 1, 500, "dizzy")] and rows(back.report) == [(3, '{"a": "боль"}')]
    assert rows(E.set_report(back.report, 3, None)) == []


def test_a_beat_near_another_is_refused(spark):
    beats = spark.createDataFrame([(0, 0, 1000, "N"), (1, 0, 5000, "N")], "record_id long, k long, t_ms long, label string")
    empty = beats.select("record_id", "t_ms", "label").limit(0)
    for t in (881, 1000, 1119):
        with pytest.raises(ValueError):
            E.add_beat(empty, beats, 0, t, "V")
    with pytest.raises(ValueError):
        E.add_beat(empty, beats, 0, 3000, "Q")
    assert [tuple(r) for t in (880, 1120, 5000) for r in E.add_beat(empty, beats, 0, t, "V").collect()] == [(0, t, "V") for t in (880, 1120, 5000)]


def test_calibration_is_the_medians_of_each_record(spark):
    """Two records of different length; one without a sinus beat has no height and width."""
    rows = [(0, k, 400 + 800 * k, "N") for k in range(900)] + [(1, k, 400 + 800 * k, "V") for k in range(60)]
    beats = spark.createDataFrame(rows, "record_id long, k long, t_ms long, label string")
    signal = synthetic.signal_of(beats, FS, MV).cache()
    lengths = signal.filter("lead = 0").selectExpr("record_id", "sample0 + size(samples) AS n").groupBy("record_id").agg({"n": "max"}).toDF("record_id", "n_samples")
    got = {r["record_id"]: r for r in P.calibrated(beats, signal, FS, MV, lengths).collect()}
    windows = S.window_metrics(signal, FS, MV).filter("ch = 1").toPandas()
    measured = S.beat_measures(signal, beats, FS, MV, lengths).toPandas().set_index(["record_id", "k"])
    for record in (0, 1):
        own = windows[windows["record_id"] == record]
        assert got[record]["noise_base_ii_mv"] == round(float(np.median(own["hf"].astype(float))) + 1e-6, 3)
        assert got[record]["wander_base_ii_mv"] == round(float(np.median(own["wander"].astype(float))), 3)
    tall, wide = ([measured.loc[(0, k)] for k in range(0, 900, step)] for step in (200, 400))
    assert got[0]["qrs_amp_mv"] == round(float(np.median([r["amp"] for r in tall if not r["edge"]])), 2)
    assert 0.5 < got[0]["qrs_amp_mv"] < 1.2  # the median of 96 ms around a beat, which a QRS fills in part, is off its height
    assert got[0]["sinus_width_ms"] == round(float(np.median([r["width"] for r in wide if not r["edge"]])), 1)
    assert got[1]["qrs_amp_mv"] is None and got[1]["sinus_width_ms"] is None
    gaps = spark.createDataFrame([(0, 3, 2800, 2600), (1, 3, 2800, 2600)], "record_id long, k long, t_ms long, rr long").join(P.calibrated(beats, signal, FS, MV, lengths), "record_id")
    checked = {r["record_id"]: r for r in S.interval_checks(signal, gaps, FS, MV, "qrs_amp_mv", "noise_base_ii_mv").collect()}
    assert checked[0]["missed"] and not checked[1]["missed"]
