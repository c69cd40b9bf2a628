"""The queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text_sql as T
from ..operators import audit as A
from ..operators import edits as E
from ..operators import episodes as X
from ..operators import intervals as Q
from ..operators import morphology as M
from ..operators import rhythm as R
from ..operators import signal as G
from ..operators import summary as S
from ..operators import views as V
from ..operators.sql import Plan, SqlOperator, Table, operator
from ..operators.store import checkpointed, laid_by_record, laid_out
from ..sources import bindings as B
from ..sources import exports, synthetic
from . import report
from .record import audited_record, calibrated, reaudited, recomputed


class Folded(Plan):
    """A step that is a function of DataFrames here and other SQL elsewhere."""

    def __init__(self, function: Callable[..., DataFrame], other: str, inputs: dict):
        step = SqlOperator(other)
        step.other = other
        super().__init__(step, inputs, {})
        self.function = function

    def made(self, frames: dict[str, DataFrame]) -> DataFrame:
        return self.function(**frames)


v_run_beats = operator("SELECT record_id, k, t_ms FROM {beat} WHERE label = 'V'")


def rhythm_plans() -> dict[str, Plan]:
    beat, long = B.many_records, B.long_records
    rr = R.rr.on(beat=beat)
    nn = R.nn_intervals.on(rr=rr)
    filtered = Folded(R.malik_filter, R.MALIK_RECURSIVE, {"nn": nn})
    long_rr = R.rr.on(beat=long)
    long_nn = R.nn_intervals.on(rr=long_rr)
    spine = R.minute_spine.on(span=R.span.on(beat=long))
    minutes = R.hr_per_minute.on(spine=spine, nn=long_nn)
    medians = R.sleep_rolling_median.on(minutes=minutes)
    sleep = R.estimate_sleep.on(medians=medians, min_len=10)
    asleep = R.minute_in_sleep.on(minutes=minutes, sleep=sleep)
    windows = R.hr_windows.on(beat=long)
    return {
        "rhythm_summary": R.rhythm_summary.on(rr=rr, nn=nn),
        "rr": rr,
        "nn_intervals": nn,
        "rhythm_ref": R.rhythm_ref.on(rr=rr),
        "rr_context": R.rr_context.on(rr=rr),
        "malik_filter": filtered,
        "hrv": R.hrv.on(filtered=filtered),
        "hr_mean": R.hr_mean.on(filtered=filtered),
        "hr_pct": R.hr_pct.on(nn=nn),
        "hr_per_minute": minutes,
        "per_minute_counts": R.per_minute_counts.on(spine=spine, beat=long),
        "hr_windows": windows,
        "hr_extremes": R.hr_extremes.on(windows=windows),
        "sleep_rolling_median": medians,
        "estimate_sleep": sleep,
        "minute_in_sleep": asleep,
        "sleep_wake_hr": R.sleep_wake_hr.on(minutes=asleep),
        "day_night_hr": R.day_night_hr.on(minutes=minutes),
        "af_screen": R.af_screen.on(nn=long_nn),
    }


def review_plans() -> dict[str, Plan]:
    beat, long = B.many_records, B.long_records
    rr = R.rr.on(beat=beat)
    features = A.stand_in_features.on(beat=beat, rhythm=R.rhythm_ref.on(rr=rr))
    audit = A.audit_verdict.on(features=features)
    family = A.stand_in_families.on(beat=beat)
    shaped = A.family_evidence.on(audit=audit, family=family)
    timed = A.on_time.on(rr=rr)
    # The long record with a reviewer's edits
    labels = E.latest_labels.on(log=E.stand_in_labels.on(beat=long))
    inserted = E.stand_in_inserted.on(beat=long)
    spans = E.live_spans.on(log=E.stand_in_spans.on(beat=long))
    diary = E.stand_in_diary.on(beat=long)
    span = R.span.on(beat=long)
    noise = E.apply_quality.on(noise=E.stand_in_noise.on(span=span, beat=long), spans=spans)
    long_rr = R.rr.on(beat=long)
    long_family = A.stand_in_families.on(beat=long)
    long_features = A.stand_in_features.on(beat=long, rhythm=R.rhythm_ref.on(rr=long_rr))
    long_audit = A.audit_verdict.on(features=long_features)
    long_shaped = A.family_evidence.on(audit=long_audit, family=long_family)
    long_on_time = A.on_time.on(rr=long_rr)
    long_timed = A.schedule_evidence.on(audit=long_shaped, on_time=long_on_time)
    # Beats under quality spans are audited anew; the rest of the review sees these audits.
    touched = E.touched_beats.on(beat=long, spans=spans)
    fresh = A.family_evidence.on(audit=A.audit_verdict.on(features=E.reaudit_features.on(features=long_features, touched=touched, noise=noise)), family=long_family)
    renewed = A.schedule_evidence.on(audit=E.replaced_audits.on(audit=long_timed, fresh=fresh), on_time=long_on_time)
    merged = E.merge_beats.on(device=long, inserted=inserted, labels=labels)
    all_features = A.stand_in_features.on(beat=long, rhythm=R.rhythm_ref.on(rr=long_rr), which="true")
    effective = E.effective_audits.on(beat=merged, audit=renewed, features=all_features)
    merged_rr = R.rr.on(beat=merged)
    gaps = X.long_intervals.on(rr=merged_rr)
    missing = X.missed_candidates.on(rr=merged_rr, context=R.rr_context.on(rr=merged_rr))
    pause = X.ep_pause.on(interval=gaps, noise_at=X.noise_at.on(interval=gaps, noise=noise), checks=X.stand_in_checks.on(interval=gaps))
    v_run, v_bad = X.ep_v_run.on(audit=effective), X.ep_v_run_rejected.on(audit=effective)
    s_run = X.ep_s_run.on(audit=effective, sinus=X.sinus_before.on(rr=merged_rr))
    missed = X.ep_missed.on(interval=missing, noise_at=X.noise_at.on(interval=missing, noise=noise), checks=X.stand_in_checks.on(interval=missing))
    bad = X.ep_noise.on(noise=noise, windows=2)
    episode = X.ep_order.on(pause=pause, v_run=v_run, v_run_rejected=v_bad, s_run=s_run, missed=missed, noise=bad)
    windows = X.noise_windows.on(noise=noise)
    nn = R.nn_intervals.on(rr=long_rr)
    minutes = R.hr_per_minute.on(spine=R.minute_spine.on(span=span), nn=nn)
    sleep = R.estimate_sleep.on(medians=R.sleep_rolling_median.on(minutes=minutes), min_len=10)
    asleep = R.minute_in_sleep.on(minutes=minutes, sleep=sleep)
    burden = S.v_burden.on(beat=merged, audit=effective)
    vt = S.vt_runs.on(episode=episode)
    hours = S.hour_spine.on(span=span)
    per_minute = R.per_minute_counts.on(spine=R.minute_spine.on(span=span), beat=long)
    counts = S.verdict_counts.on(audit=effective)
    by_hand = S.hand_labels.on(family=long_family, labels=labels)
    score = S.family_score.on(family=long_family, audit=long_timed, by_hand=by_hand)
    families = S.family_summary.on(family=long_family, audit=long_timed)
    long_shapes = S.morphologies.on(audit=effective)
    ranked = S.strip_rank.on(audit=effective, morphologies=long_shapes, episode=episode)
    # Variability is that of the device's labels, the mean rate that of the merged beats.
    hrv = R.hrv.on(filtered=Folded(R.malik_filter, R.MALIK_RECURSIVE, {"nn": nn}))
    merged_nn = R.nn_intervals.on(rr=merged_rr)
    mean = R.hr_mean.on(filtered=Folded(R.malik_filter, R.MALIK_RECURSIVE, {"nn": merged_nn}))
    extremes = R.hr_extremes.on(windows=R.hr_windows.on(beat=merged))
    sinus = S.strip_sinus.on(minutes=asleep, mean=mean, noise=noise)
    totals = S.beat_totals.on(beat=merged)
    edits = E.edit_counts.on(span=span, labels=labels, inserted=inserted, spans=spans)
    overview = V.overview.on(minutes=minutes, counts=per_minute, audit=effective)
    summary = V.summary.on(
        span=span, device=S.device_counts.on(beat=long), total=totals, audited=S.audited_counts.on(audit=effective), clean=S.clean_pct.on(noise=noise), pauses=S.pauses.on(rr=merged_rr, episode=episode), burden=burden,
        extremes=extremes, day_night=R.day_night_hr.on(minutes=minutes), sleep_wake=R.sleep_wake_hr.on(minutes=asleep), pct=R.hr_pct.on(nn=merged_nn),
    )
    hourly_sums = S.bin_sums.on(overview=overview, minutes=60)
    return {
        "audit_features": features,
        "audit_verdict": audit,
        "family_evidence": shaped,
        "on_time": timed,
        "schedule_evidence": A.schedule_evidence.on(audit=shaped, on_time=timed),
        "latest_labels": labels,
        "live_spans": spans,
        "merge_beats": merged,
        "effective_audits": effective,
        "apply_quality": noise,
        "touched_beats": touched,
        "fresh_audits": fresh,
        "reaudited": renewed,
        "event_context": E.event_context.on(diary=diary, rr=merged_rr, audit=effective, episode=episode, noise=noise),
        "insertable": E.insertable.on(wanted=inserted, beat=long),
        "export_beats": E.export_beats.on(beat=merged),
        "beat_info": E.beat_info.on(beat=merged, audit=effective),
        "beats_window": E.beats_window.on(beat=merged),
        "edit_counts": edits,
        "noise_at": X.noise_at.on(interval=gaps, noise=noise),
        "ep_pause": pause,
        "ep_v_run": v_run,
        "ep_v_run_rejected": v_bad,
        "ep_s_run": s_run,
        "ep_missed": missed,
        "ep_noise": bad,
        "ep_order": episode,
        "noise_runs": X.noise_runs.on(noise=noise),
        "noise_windows": windows,
        "merge_noise": X.merge_noise.on(windows=windows),
        "step_episode": X.step_episode.on(episode=episode),
        "step_beat": X.step_beat.on(audit=effective),
        "runs": R.runs.on(picked=v_run_beats.on(beat=beat)),
        "verdict_counts": counts,
        "device_counts": S.device_counts.on(beat=beat),
        "audited_counts": S.audited_counts.on(audit=effective),
        "clean_pct": S.clean_pct.on(noise=noise),
        "pauses": S.pauses.on(rr=merged_rr, episode=episode),
        "v_burden": burden,
        "morphologies": long_shapes,
        "vt_runs": vt,
        "criteria": S.criteria.on(burden=burden, episode=episode, vt=vt, af=R.af_screen.on(nn=merged_nn)),
        "density_class": S.density_class.on(burden=burden),
        "circadian_type": S.circadian_type.on(minutes=asleep, audit=effective),
        "hourly": S.hourly.on(hours=hours, beat=merged, minutes=asleep, audit=effective, episode=episode, noise=noise),
        "kept_in": S.kept_in.on(episode=episode, audit=effective),
        "auto_strips": S.auto_strips.on(sinus=sinus, extremes=extremes, minutes=asleep, episode=episode, ranked=ranked, diary=diary, span=span),
        "strip_rank": ranked,
        "strip_sinus": sinus,
        "templates_list": S.templates_list.on(family=long_family, labels=labels),
        "template_hours": S.template_hours.on(family=long_family, span=span),
        "template_beats": S.template_beats.on(family=long_family),
        "family_summary": families,
        "hand_labels": by_hand,
        "family_sample": S.family_sample.on(family=long_family),
        "family_score": score,
        "bucket_counts": S.bucket_counts.on(score=score),
        "in_bucket": S.in_bucket.on(score=score),
        "bin_sums": S.bin_sums.on(overview=overview),
        "hourly_sums": hourly_sums,
        "hr_bounds": S.hr_bounds.on(minutes=minutes),
        "night_minutes": S.night_minutes.on(minutes=minutes),
        "peak_hour": S.peak_hour.on(hours=hourly_sums),
        "stats_cards": S.stats_cards.on(mean=mean, hrv=hrv, summary=summary, morphologies=long_shapes, counts=counts, edits=edits),
        "dumbbell": S.dumbbell.on(summary=summary, episode=episode),
        "overview": overview,
        "summary": summary,
        "header": V.header.on(records=V.stand_in_records.on(beat=long), span=span, counted=totals),
        "hours_note": V.hours_note.on(hours=S.template_hours.on(family=long_family, span=span)),
        "top_reason": V.top_reason.on(summary=families),
        "verdict_ru": V.verdict_ru.on(audit=effective),
        "verdict_text": V.verdict_text.on(score=score, reasons=V.top_reason.on(summary=families)),
        "feat_rows": V.feat_rows.on(features=features),
        "hr_ticks": V.hr_ticks.on(bounds=S.hr_bounds.on(minutes=minutes)),
        "clamp_range": V.clamp_range.on(episode=episode, span=span),
    }


def signal_plans() -> dict[str, Plan]:
    samples = B.samples
    windows = G.qwin_metrics.on(samples=samples)
    points = M.shape_points.on(embeddings=Table("embeddings"))
    centres = M.centres.on(points=points)
    text = T.report_numbers.on(beat=B.long_records)
    return {
        "samples": samples,
        "sig_running_sum": G.sig_running_sum.on(samples=samples),
        "sig_box": G.sig_box.on(samples=samples),
        "sig_hf_residual": G.sig_hf_residual.on(samples=samples),
        "sig_baseline": G.sig_baseline.on(samples=samples),
        "qwin_metrics": windows,
        "noise_score": G.noise_score.on(windows=windows, wander_min="30e0", wander_ratio="1.2e0"),
        "gain_pick": G.gain_pick.on(samples=samples),
        "row_minmax": G.row_minmax.on(samples=samples),
        "row_median": G.row_median.on(samples=samples),
        "mv_window": G.mv_window.on(samples=samples),
        "sinus_sample": G.sinus_sample.on(beat=B.long_records, stride=20, per_hour=15),
        "qt_sinus_beats": Q.sinus_beats.on(beat=B.long_records, least=20, per_hour=10),
        "shape_points": points,
        "norm_window": M.norm_window.on(points=points),
        "shape_centres": centres,
        "nearest_centre": M.nearest_centre.on(points=points, centres=centres),
        "report_numbers": text,
        "mean_wave": M.mean_wave.on(family=V.wave_family.on(points=points), points=V.wave_points.on(points=points)),
    }


FS, MV = 125, 0.001747


#: Signals at rest, by data folder (see store_signal); where there is none, a query draws its own.
STORED: dict[str, str] = {}


def store_signal(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the long records' signal by lead, which later queries on sf_dir read: a lead's files, and of these the row groups of chunks."""
    signal = G.as_rows(_record(spark, sf_dir)[1], tuple(range(len(synthetic.HEIGHT))))
    signal.repartition("record_id").sortWithinPartitions("lead", "record_id", "chunk").write.option("parquet.block.size", 8 << 20).partitionBy("lead").parquet(folder)
    STORED[sf_dir] = folder


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long records' beats with what edits are made of, written once, by record: they are dealt and sorted anew wherever they are made."""
    return laid_out(B.long_records.frame(spark, sf_dir).select("record_id", "k", "t_ms", "label", "event_id", "pk"))


def _spans(beats: DataFrame) -> DataFrame:
    """The live quality spans of beats. They are few, and noise and touched beats both read them."""
    return checkpointed(E.live_spans(log=E.stand_in_spans(beat=beats)))


def _record(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame | G.Source, DataFrame]:
    """The long records' beats (of those held, where they are), their signal (drawn where it is read, or a stored one), and their lengths in samples."""
    own = B.long_records.frame(spark, sf_dir) if held is None else held
    beats = own.select("record_id", "k", "t_ms", "label")
    beats = laid_out(beats) if held is None else beats  # every pass reads them
    lengths = beats.groupBy("record_id").agg(F.expr(f"(max(t_ms) + 1000) * {FS} div 1000").alias("n_samples"))
    if sf_dir in STORED:
        return beats, spark.read.parquet(STORED[sf_dir]).select("record_id", "lead", "chunk", "sample0", "samples"), lengths
    return beats, synthetic.source_of(beats, FS, MV), lengths


def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.window_metrics(_record(spark, sf_dir)[1], FS, MV)


def heavy_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a record alone, up to audited labels: windows, noise, measures, families, evidence."""
    beats, signal, n = _record(spark, sf_dir)
    return audited_record(beats, signal, FS, MV, n).audit


def record_reaudited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy pass under quality spans, from samples."""
    held = _beats(spark, sf_dir)
    beats, signal, n = _record(spark, sf_dir, held)
    return reaudited(audited_record(beats, signal, FS, MV, n), _spans(held))


def beat_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats, signal, n = _record(spark, sf_dir)
    return M.clustered(laid_by_record(M.beat_pieces(signal, beats, FS, MV, n))).family


def record_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All episodes under the reviewer's edits, from samples: no stand-in but the edits."""
    held = _beats(spark, sf_dir)
    beats, signal, n = _record(spark, sf_dir, held)
    labels, inserted = E.latest_labels(log=E.stand_in_labels(beat=held)), E.stand_in_inserted(beat=held)
    return recomputed(audited_record(beats, signal, FS, MV, n), signal, labels, inserted, _spans(held), FS, MV, n).episodes


def family_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their counts and mean waves, from samples."""
    beats, signal, n = _record(spark, sf_dir)
    base = audited_record(beats, signal, FS, MV, n)
    return M.views_of(base.family, base.audit, base.waves, FS)


def qt_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats, signal, n = _record(spark, sf_dir)
    return Q.qt_hours(signal, Q.sinus_beats(beat=beats), FS, MV, n)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats, signal, n = _record(spark, sf_dir)
    return calibrated(beats, signal, FS, MV, n)


def interval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the signal says of long intervals, held against each record's own calibration."""
    beats, signal, n = _record(spark, sf_dir)
    long = R.rr(beat=beats).filter("rr > 2000").select("record_id", "k", "t_ms", "rr").join(calibrated(beats, signal, FS, MV, n), "record_id")
    return G.interval_checks(signal, long, FS, MV, "qrs_amp_mv", "noise_base_ii_mv")


def record_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses from samples: calibration, noise of windows and checks of the signal, with no stand-in."""
    beats, signal, n = _record(spark, sf_dir)
    gaps = X.long_intervals(rr=R.rr(beat=beats))
    noise = G.noise_score(windows=G.window_metrics(signal, FS, MV))
    checks = G.interval_checks(signal, gaps.join(calibrated(beats, signal, FS, MV, n), "record_id"), FS, MV, "qrs_amp_mv", "noise_base_ii_mv")
    return X.ep_pause(interval=gaps, noise_at=X.noise_at(interval=gaps, noise=noise), checks=checks)


def raw_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source of stored records prunes to this lead and chunk by itself (see sources.scp).
    return G.raw_window(_record(spark, sf_dir)[1], 1, 60 * FS, 70 * FS, FS)


def ecg_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats, signal, n = _record(spark, sf_dir)
    return G.ecg_window(signal, [0, 1, 6], 60, 10, FS, MV, calibrated(beats, signal, FS, MV, n))


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[dict[str, Plan], dict, Callable[[str], DataFrame]]:
    """The review's plans, their tables as they are made, and a getter by name. What most of the others read is written first."""
    p, made = review_plans(), {}
    for name in ("merge_beats", "apply_quality", "effective_audits", "ep_order", "summary"):
        p[name].frame(spark, sf_dir, made)
        p[name].written(made)
    return p, made, lambda name: p[name].frame(spark, sf_dir, made)


def _rates(spark: SparkSession, sf_dir: str, p: dict[str, Plan], made: dict) -> tuple[DataFrame, DataFrame]:
    """Variability of the device's labels, and the mean rate of the merged beats."""
    filtered = lambda beat: R.malik_filter(R.nn_intervals.on(rr=R.rr.on(beat=beat)).frame(spark, sf_dir, made))
    return R.hrv(filtered=filtered(B.long_records)), R.hr_mean(filtered=filtered(p["merge_beats"]))


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, made, get = _reviewed(spark, sf_dir)
    summary, records = get("summary"), V.stand_in_records.on(beat=B.long_records).frame(spark, sf_dir)
    hrv, mean = _rates(spark, sf_dir, p, made)
    rates = summary.select("record_id", "hr_min", "min_at_s", "hr_max", "max_at_s", "night", "day", "sleep", "wake", "pct_over_100", "pct_under_50")
    one = {
        "record": summary.select("record_id", "duration_s", "beats", "clean_pct").join(records.select("record_id", "start"), "record_id"),
        "patient": records.select("record_id", "sex", "age"),
        "hr": rates.join(mean.withColumnRenamed("hr", "mean"), "record_id", "left"),
        "hrv": hrv,
        "counts": summary.select("record_id", "device_n", "device_v", "device_s", "kept_v", "v_likely", "kept_s", "pauses_device", "pauses_real").join(get("edit_counts"), "record_id", "left"),
    }
    edits = {"events": "event_context", "manual_labels": "latest_labels", "manual_quality": "live_spans"}
    many = {k: get(v) for k, v in edits.items()} | {"manual_added": get("merge_beats").filter("origin < 0").select("record_id", "t_ms", "label")}
    return exports.export_json(get("export_beats"), get("ep_order"), get("verdict_counts"), get("criteria"), one, many)


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, made, get = _reviewed(spark, sf_dir)
    records = V.stand_in_records.on(beat=B.long_records).frame(spark, sf_dir)
    return report.summary_rows(records, get("summary"), *_rates(spark, sf_dir, p, made), get("ep_order"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, made, get = _reviewed(spark, sf_dir)
    hrv, mean = _rates(spark, sf_dir, p, made)
    circadian = p["circadian_type"]
    minutes = circadian.inputs["minutes"].frame(spark, sf_dir, made)
    circadian_s = S.circadian_type(minutes=minutes, audit=get("effective_audits"), label="S")
    records = V.stand_in_records.on(beat=B.long_records).frame(spark, sf_dir)
    return report.sections(
        records, get("summary"), mean, hrv, minutes, get("ep_order"), get("morphologies"), get("circadian_type"), circadian_s, get("kept_in"), get("criteria"), Q.qt_summary(qt_hours(spark, sf_dir)), get("event_context"), get("edit_counts")
    )


#: Queries that no SQL form is given for
KERNELS = {f.__name__: f for f in (window_metrics, heavy_pass, record_reaudited, record_episodes, beat_families, family_views, qt_hours, calibration, interval_checks, record_pauses, raw_window, ecg_window, export_json, sections, summary_rows)}


def plans() -> dict[str, Plan]:
    return rhythm_plans() | review_plans() | signal_plans()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: p.query() for name, p in plans().items()} | KERNELS


def oracle_sql() -> dict[str, str]:
    return {name: p.sql() for name, p in plans().items()}
