"""Runs of ectopic beats."""

from pulseforge.operators import episodes as X


def test_a_run_in_one_place_has_no_finite_rate(spark):
    """An inserted beat may lie on a device's: no time passes from the one to the other."""
    rows = [(0, 4, 9000, "V", "manual", 1.0), (0, 5, 9000, "V", "likely", 0.8), (0, 9, 12000, "V", "likely", 0.8), (0, 10, 12500, "V", "likely", 0.8)]
    rows += [(1, k, 7000, "V", "narrow", 0.7) for k in range(3)] + [(2, k, 7000, "S", "likely", 0.8) for k in range(3)]
    audit = spark.createDataFrame(rows, "record_id long, k long, t_ms long, label string, verdict string, confidence double")
    assert [(r["t_ms"], r["dur_ms"], r["title"]) for r in X.ep_v_run(audit=audit).orderBy("t_ms").collect()] == [(9000, 0, "ЖЭС пара, inf/мин"), (12000, 500, "ЖЭС пара, 120/мин")]
    assert [r["title"] for r in X.ep_v_run_rejected(audit=audit).collect()] == ["«ЖЭС ×3, inf/мин»"]
    sinus = spark.createDataFrame([(2, 0, 800.0)], "record_id long, k long, median double")
    assert [(r["verdict"], r["title"]) for r in X.ep_s_run(audit=audit, sinus=sinus).collect()] == [("review", "НЖЭС ×3, inf/мин")]


def test_a_sinus_rhythm_of_no_time_is_faster_than_any_run(spark):
    rows = [(2, k, 7000 + 500 * k, "S", "likely", 0.8) for k in range(3)] + [(3, k, 7000, "S", "likely", 0.8) for k in range(3)]
    audit = spark.createDataFrame(rows, "record_id long, k long, t_ms long, label string, verdict string, confidence double")
    sinus = spark.createDataFrame([(2, 0, 0.0), (3, 0, 0.0)], "record_id long, k long, median double")
    assert [(r["verdict"], r["title"]) for r in X.ep_s_run(audit=audit, sinus=sinus).orderBy("record_id").collect()] == [("artifact", "«НЖТ ×3, 120/мин»"), ("review", "НЖЭС ×3, inf/мин")]
