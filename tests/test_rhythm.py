"""Hand-computed cases, and plain loops beside the SQL operators."""

import random
import statistics

import numpy as np
import pytest

from pulseforge.operators import audit as A
from pulseforge.operators import edits as E
from pulseforge.operators import episodes as X
from pulseforge.operators import rhythm as R


def beats(spark, *records):
    rows = [(r, k, t, label) for r, (times, labels) in enumerate(records) for k, (t, label) in enumerate(zip(times, labels, strict=True))]
    return spark.createDataFrame(rows, "record_id long, k long, t_ms long, label string")


def test_nn_intervals(spark):
    t = [0, 800, 1600, 1700, 2500, 5000]
    rows = R.nn_intervals(rr=R.rr(beat=beats(spark, (t, "NNNNNN"), (t, "NNVNNN")))).orderBy("record_id", "k").collect()
    assert [(r["record_id"], r["t_ms"], r["nn"]) for r in rows] == [(0, 0, 800), (0, 800, 800), (0, 1700, 800), (1, 0, 800), (1, 1700, 800)]


def test_runs(spark):
    picked = spark.createDataFrame([(0, k, k * 100) for k in (1, 2, 3, 7, 9, 10)], "record_id long, k long, t_ms long")
    assert [(r["k0"], r["k1"]) for r in R.runs(picked=picked).orderBy("k0").collect()] == [(1, 3), (9, 10)]


def test_sleep(spark):
    def found(values):
        minutes = spark.createDataFrame([(0, m, float(v)) for m, v in enumerate(values)], "record_id long, m long, hr double")
        return [(r["m0"], r["m1"]) for r in R.estimate_sleep(medians=R.sleep_rolling_median(minutes=minutes)).collect()]

    assert found([75] * 300 + [50] * 120 + [75] * 300) == [(300, 420)]
    assert found([75] * 60 + [50] * 59) == []


def test_hr_extremes(spark):
    t = [*range(0, 60_000, 1000), *range(60_000, 90_000, 375), *range(90_000, 150_000, 1000)]
    r = R.hr_extremes(windows=R.hr_windows(beat=beats(spark, (t, "N" * len(t))))).first()
    assert (round(r["hr_min"]), round(r["hr_max"])) == (60, 160)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    r = random.Random(seed)
    t = list(np.cumsum([r.choice([250, 700, 800, 820, 900, 1500, 2500]) for _ in range(300)]))
    t = [int(x) for x in t]
    labels = [r.choice("NNNNNVS") for _ in t]
    rr = R.rr(beat=beats(spark, (t, labels))).cache()
    gaps = np.diff(t)
    nn = [(k, int(g)) for k, g in enumerate(gaps) if labels[k] == labels[k + 1] == "N" and 300 < g < 2000]
    kept, last = [], None
    for k, v in nn:
        ok = last is None or abs(v - last) / last <= 0.2
        kept.append(ok)
        last = v if ok else last
    got = R.malik_filter(R.nn_intervals(rr=rr)).orderBy("k").collect()
    assert [(x["k"], x["nn"], x["kept"]) for x in got] == [(k, v, o) for (k, v), o in zip(nn, kept, strict=True)]
    series = np.array([v for (_, v), o in zip(nn, kept, strict=True) if o], float)
    h = R.hrv(filtered=R.malik_filter(R.nn_intervals(rr=rr))).first()
    assert h["n"] == len(series) and abs(h["sdnn"] - series.std()) < 1e-3 and abs(h["rmssd"] - np.sqrt((np.diff(series) ** 2).mean())) < 1e-3
    ref = {x["k"]: x["rhythm"] for x in R.rhythm_ref(rr=rr).collect()}
    for k in range(len(t)):
        want = None
        for back in (6, 20):
            prev = [gaps[j] for j in range(max(0, k - back), k - 1) if labels[j] == labels[j + 1] == "N"]
            if prev and want is None:
                want = statistics.median(prev)
        assert ref[k] == want
    median = {x["k"]: x["median"] for x in R.rr_context(rr=rr).collect()}
    for k in range(8, len(gaps) - 8):
        assert median[k] == np.median(np.r_[gaps[k - 8 : k], gaps[k + 1 : k + 9]])
    assert len(median) == len(gaps) - 16


def plain_malik(nn):
    kept, last = [], None
    for v in nn:
        kept.append(last is None or abs(v - last) / last <= 0.2)
        last = v if kept[-1] else last
    return kept


def test_malik_filter_of_long_records(spark, monkeypatch):
    """Records of many segments, one whose states never agree in a segment, one without intervals for a while, and short ones."""
    monkeypatch.setattr(R, "SEGMENT_MS", 20_000)
    r = random.Random(9)
    made = {0: [r.choice([500, 560, 610, 700, 900, 1400]) for _ in range(900)], 1: [r.choice([400, 1900]) for _ in range(300)], 2: [800], 3: [r.randrange(301, 2000) for _ in range(500)]}
    made[4] = [600] * 20 + [1000] * 200 + [650] * 3
    rows, want = [], {}
    for record, nn in made.items():
        t = np.cumsum(nn) + np.where(np.arange(len(nn)) > len(nn) // 2, 90_000 * record, 0)
        rows += [(record, k, int(x), v) for k, (x, v) in enumerate(zip(t, nn, strict=True))]
        want |= {(record, k): x for k, x in enumerate(plain_malik(nn))}
    got = R.malik_filter(spark.createDataFrame(rows, "record_id long, k long, t_ms long, nn long").repartition(5)).collect()
    assert {(x["record_id"], x["k"]): x["kept"] for x in got} == want and len(got) == len(rows)
    assert 0 < sum(want.values()) < len(want)
    assert R.malik_filter(spark.createDataFrame([], "record_id long, k long, t_ms long, nn long")).collect() == []


def test_segments_of_the_malik_filter():
    r = random.Random(2)
    for _ in range(300):
        nn = np.array([r.choice([400, 470, 480, 481, 600, 1100, 1321]) for _ in range(r.randrange(1, 12))])
        states = np.arange(301, 2000)
        ends = R.ends_of(nn, states)
        for last in (301, 400, 555, 1099, 1999):
            kept, end = R.kept_after(nn, last)
            plain = plain_malik([last, *nn.tolist()])
            assert kept.tolist() == plain[1:] and end == [last, *nn.tolist()][max(k for k, ok in enumerate(plain) if ok)]
            assert (ends[0] if len(ends) == 1 else ends[last - 301]) == end


def cascade(verdicts, timed):
    """The schedule's evidence beat by beat: verdicts by index, changed from left to right."""
    out = dict(verdicts)
    for k in sorted(out):
        if out[k] in ("likely", "uncertain") and timed.get(k) and out.get(k - 1, "likely") not in ("likely", "uncertain", "manual") and k - 1 in out:
            out[k] = "on-schedule"
    return out


def test_schedule_evidence(spark):
    t = [0, 800, 1600, 2000, 2400, 3200, 4000]
    timed = {r["k"]: r["on_time"] for r in A.on_time(rr=R.rr(beat=beats(spark, (t, "NNNSSNN")))).collect()}
    assert timed[4] and not timed[3]
    r = random.Random(5)
    ks = sorted(r.sample(range(400), 300))
    verdicts = {k: r.choice(["likely", "uncertain", "noisy", "manual", "narrow", "likely", "uncertain"]) for k in ks}
    on = {k: r.random() < 0.7 for k in range(400)}
    audit = spark.createDataFrame([(0, k, k, "S", 1, 0.5, v, 0.5) for k, v in verdicts.items()], "record_id long, k long, t_ms long, label string, family long, family_n_frac double, verdict string, confidence double")
    time = spark.createDataFrame([(0, k, v) for k, v in on.items()], "record_id long, k long, on_time boolean")
    assert {x["k"]: x["verdict"] for x in A.schedule_evidence(audit=audit, on_time=time).collect()} == cascade(verdicts, on)


def test_edits(spark):
    device = beats(spark, ([0, 800, 1600, 2400], "NVNN"))
    log = spark.createDataFrame([(0, 800, 1, "S"), (0, 800, 2, "N"), (0, 1600, 3, "V"), (0, 1600, 4, None), (0, 999, 5, "V")], "record_id long, t_ms long, seq long, label string")
    inserted = spark.createDataFrame([(0, 1200, "V"), (0, 800, "X")], "record_id long, t_ms long, label string")
    merged = E.merge_beats(device=device, inserted=inserted, labels=E.latest_labels(log=log)).orderBy("k").collect()
    assert [(r["t_ms"], r["label"], r["origin"]) for r in merged] == [(0, "N", 0), (800, "N", 1), (800, "X", -1), (1200, "V", -1), (1600, "N", 2), (2400, "N", 3)]
    allowed = {r["t_ms"]: r["allowed"] for r in E.insertable(wanted=inserted, beat=device).collect()}
    assert allowed == {1200: True, 800: False}
    assert E.set_label(log, 0, 5, "V").agg({"seq": "max"}).first()[0] == 6
    with pytest.raises(ValueError, match="label must be"):
        E.set_label(log, 0, 5, "Q")
    spans = spark.createDataFrame([(0, 1, 1000, 5000, "noise"), (0, 2, 3000, 4000, "clean"), (0, 3, 9000, 12000, "noise"), (0, 4, 11000, 11500, None)], "record_id long, seq long, t0_ms long, t1_ms long, v string")
    noise = spark.createDataFrame([(0, w, 0.3, 0.2) for w in range(8)], "record_id long, w long, noise double, sharp double")
    got = {r["w"]: r["noise"] for r in E.apply_quality(noise=noise, spans=E.live_spans(log=spans)).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.3, 4: 0.3, 5: 0.3, 6: 0.3, 7: 0.3}


def test_noise_episode(spark):
    noise = spark.createDataFrame([(0, w, 0.9, 0.9 if 3 <= w < 20 else 0.1) for w in range(40)], "record_id long, w long, noise double, sharp double")
    r = X.ep_noise(noise=noise).collect()
    assert [(x["t_ms"], x["dur_ms"], x["title"]) for x in r] == [(6000, 34000, "Помеха 34 с")]
