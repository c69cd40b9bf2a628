"""A record from samples to audited labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_round
from ..operators import audit as A
from ..operators import edits as E
from ..operators import episodes as X
from ..operators import morphology as M
from ..operators import rhythm as R
from ..operators import signal as G
from ..operators.store import checkpointed, laid_out


def audit_features(beats: DataFrame, measures: DataFrame, sampled: DataFrame, noise: DataFrame, noise_base: DataFrame, rhythm: DataFrame, which: DataFrame | None = None) -> DataFrame:
    """Features of audited beats (which: of these instead) from measures (record_id, k, edge, amp, width, noise_mv) of them and of sampled sinus beats
    (record_id, k, h, amplitude: whether it counts for the hour's amplitude, else for the sinus width)."""
    known = sampled.join(measures.filter("not edge"), ["record_id", "k"])
    hours = known.filter("amplitude").groupBy("record_id", "h").agg(F.percentile("amp", 0.5).alias("ref_amp"))
    widths = known.filter("not amplitude").groupBy("record_id").agg(F.percentile("width", 0.5).alias("sinus_width"))
    last = hours.groupBy("record_id").agg(F.max("h").alias("last_h"))
    rr = R.rr(beat=beats)
    near = rr.selectExpr("record_id", "k", "t_ms", "label", "rr as rr_post", "lag(rr) over (partition by record_id order by k) as rr_pre")
    near = near.filter("label <> 'N'") if which is None else near.join(which.select("record_id", "k"), ["record_id", "k"], "left_semi")
    near = near.join(last, "record_id", "left").withColumn("h", F.least(F.expr("t_ms div 3600000"), F.col("last_h")))
    x = near.join(measures, ["record_id", "k"]).join(hours, ["record_id", "h"], "left").join(widths, "record_id", "left").join(noise_base, "record_id", "left").join(rhythm, ["record_id", "k"], "left")
    windows = noise.groupBy("record_id").agg(F.max("w").alias("last_w"))
    x = x.join(windows, "record_id").withColumn("w", F.least(F.expr("t_ms div 2000"), F.col("last_w"))).join(noise.select("record_id", "w", F.col("sharp").alias("win_noise")), ["record_id", "w"], "left")
    x = x.withColumn("width_ms", python_round(F.col("width"), 1)).withColumn("amp_ratio", python_round(F.try_divide("amp", "ref_amp"), 3))
    x = x.withColumn("noise_ratio", python_round(F.try_divide("noise_mv", "noise_base"), 2)).withColumn("width_ratio", python_round(F.try_divide("width_ms", "sinus_width"), 2))
    x = x.withColumn("prematurity", python_round(F.try_divide(F.col("rr_pre"), F.col("rhythm")), 2))
    return x.select("record_id", "k", "t_ms", "label", "rr_pre", "rr_post", "edge", "amp_ratio", "noise_ratio", "noise_mv", "ref_amp", "win_noise", "width_ms", "sinus_width", "width_ratio", "prematurity")


def sinus_sampled(beats: DataFrame) -> DataFrame:
    """Sinus beats (record_id, k, t_ms, h, amplitude) that references are measured on: of amplitude by hour, or of width."""
    of = lambda stride, per_hour, amplitude: G.sinus_sample(beat=beats, stride=stride, per_hour=per_hour).withColumn("amplitude", F.lit(amplitude))
    return of(200, 150, True).unionByName(of(400, 40, False))


def calibration(measures: DataFrame, sampled: DataFrame, windows: DataFrame) -> DataFrame:
    """(record_id, sinus_width_ms, noise_base_ii_mv, wander_base_ii_mv, qrs_amp_mv): what of a record the checks of its signal are held
    against. Medians, of amplitude over the medians of hours; null where no sinus beat was measured."""
    known = sampled.join(measures.filter("not edge"), ["record_id", "k"])
    median = lambda c: F.percentile(F.col(c).cast("double"), 0.5)
    heights = known.filter("amplitude").groupBy("record_id", "h").agg(median("amp").alias("amp")).groupBy("record_id").agg(median("amp").alias("height"))
    widths = known.filter("not amplitude").groupBy("record_id").agg(median("width").alias("width"))
    bases = windows.filter("ch = 1").groupBy("record_id").agg((median("hf") + 1e-6).alias("hf"), median("wander").alias("wander"))
    x = bases.join(heights, "record_id", "left").join(widths, "record_id", "left")
    return x.select("record_id", python_round(F.col("width"), 1).alias("sinus_width_ms"), python_round(F.col("hf"), 3).alias("noise_base_ii_mv"), python_round(F.col("wander"), 3).alias("wander_base_ii_mv"), python_round(F.col("height"), 2).alias("qrs_amp_mv"))


def calibrated(beats: DataFrame, signal: DataFrame | G.Source, fs: int, mv: float, lengths: DataFrame | int) -> DataFrame:
    """The calibration of records from their samples: windows of lead II alone, and the surroundings of sampled beats, which heights and widths
    both read and so are measured once."""
    sampled = sinus_sampled(beats)
    measures = checkpointed(G.beat_measures(signal, sampled.select("record_id", "k", "t_ms").distinct(), fs, mv, lengths))
    return calibration(measures, sampled.drop("t_ms"), G.window_metrics(signal, fs, mv, (G.INDEPENDENT[1],)))


@dataclass
class HeavyPass:
    """The tables that depend on records alone, which edits are applied to."""

    beats: DataFrame  #: record_id, k, t_ms, label
    noise: DataFrame  #: record_id, w, noise, sharp
    features: DataFrame  #: of the audited beats
    windows: DataFrame  #: record_id, k, t_ms, label, window
    family: DataFrame  #: record_id, k, t_ms, label, family
    on_time: DataFrame  #: record_id, k, t_ms, label, on_time
    audit: DataFrame  #: record_id, k, t_ms, label, family, family_n_frac, before, verdict, confidence
    calibration: DataFrame | None = None  #: what checks of a record's signal are held against, see calibration
    known: tuple[DataFrame, ...] = ()  #: what features are made of besides a beat's own: measures, sampled beats, noise base, rhythm
    waves: DataFrame | None = None  #: of each family, see M.Clustered


def reaudited(base: HeavyPass, spans: DataFrame) -> DataFrame:
    """base.audit under live quality spans (record_id, seq, t0_ms, t1_ms, v).

    Beats that spans touch, and their neighbours, are audited anew, with the evidence of their families; then the schedule runs
    over the records that have any. All other records keep their rows. A span that is taken back leaves base.audit as it was.
    """
    touched = E.touched_beats(beat=base.beats, spans=spans)
    noise = E.apply_quality(noise=base.noise, spans=spans)
    fresh = A.family_evidence(audit=A.audit_verdict(features=E.reaudit_features(features=base.features, touched=touched, noise=noise)), family=base.family)
    changed = touched.select("record_id").distinct()
    own = lambda df, how="left_semi": df.join(changed, "record_id", how)
    again = A.schedule_evidence(audit=E.replaced_audits(audit=own(base.audit), fresh=fresh), on_time=own(base.on_time))
    return own(base.audit, "left_anti").unionByName(again)


def scanned(beats: DataFrame, sampled: DataFrame, signal: DataFrame | G.Source, fs: int, mv: float, lengths: DataFrame | int) -> G.Scanned:
    """One pass over the samples: windows, measures of audited and sampled beats, shapes of all."""
    places, windows = [G.INDEPENDENT.index(lead) for lead in M.LEADS], M.windows_of(fs, mv)
    flagged = beats.select("record_id", "k", "t_ms", "label").join(sampled.select("record_id", "k", F.lit(True).alias("sampled")).distinct(), ["record_id", "k"], "left")
    flagged = flagged.withColumn("wanted", F.coalesce("sampled", F.lit(False)) | (F.col("label") != "N"))
    return G.one_scan(signal, flagged, fs, mv, lengths, lambda x, start, t, n: windows(x[places], start, t, n))


def audited_record(beats: DataFrame, signal: DataFrame | G.Source, fs: int, mv: float, lengths: DataFrame | int) -> HeavyPass:
    sampled = checkpointed(sinus_sampled(beats))  # few, and read by every reference
    scan = scanned(beats, sampled, signal, fs, mv, lengths)
    noise = laid_out(G.noise_score(windows=scan.windows), moved=False)
    base = scan.windows.filter(F.col("ch") == 1).groupBy("record_id").agg((F.percentile("hf", 0.5) + 1e-6).alias("noise_base"))
    rr = R.rr(beat=beats)
    rhythm = R.rhythm_ref(rr=rr)
    # Whatever joins by beat or window lies by record: it is written so, and later readers neither move nor make it again.
    features = laid_out(audit_features(beats, scan.measures, sampled.drop("t_ms"), noise, base, rhythm), moved=False)
    shapes = M.clustered(scan.pieces)
    family = laid_out(shapes.family, moved=False)
    shaped = A.family_evidence(audit=A.audit_verdict(features=features), family=family)
    on_time = A.on_time(rr=rr)
    audit = laid_out(A.schedule_evidence(audit=shaped, on_time=on_time), moved=False)
    limits = calibration(scan.measures, sampled.drop("t_ms"), scan.windows)
    return HeavyPass(beats, noise, features, scan.shapes, family, on_time, audit, limits, (scan.measures, sampled.drop("t_ms"), base, rhythm), shapes.waves)


def around(signal: DataFrame | G.Source, beats: DataFrame, fs: int) -> DataFrame | G.Source:
    """The chunks that beats lie in, and their neighbours."""
    length = G.chunk_length(fs)
    near = beats.select("record_id", F.explode(F.expr(f"sequence(cast(floor(t_ms * {fs} / 1000 / {length}) as int) - 1, cast(floor(t_ms * {fs} / 1000 / {length}) as int) + 1)")).alias("chunk")).distinct()
    if isinstance(signal, G.Source):
        return signal.of(signal.chunks.join(near, ["record_id", "chunk"], "left_semi"))
    return signal.join(near, ["record_id", "chunk"], "left_semi")


@dataclass
class Edited:
    """What a reviewer's edits make of a record."""

    beats: DataFrame  #: merged: record_id, k, t_ms, origin, device_label, label, relabelled
    noise: DataFrame
    audit: DataFrame  #: effective, by the merged beats' k
    episodes: DataFrame


def recomputed(base: HeavyPass, signal: DataFrame | G.Source, labels: DataFrame, inserted: DataFrame, spans: DataFrame, fs: int, mv: float, lengths: DataFrame | int) -> Edited:
    """labels: record_id, t_ms, label; inserted: record_id, t_ms, label; spans: record_id, seq, t0_ms, t1_ms, v. Of the samples only the
    chunks are read that hold relabelled sinus beats, long intervals or intervals that a missed beat would explain."""
    noise = E.apply_quality(noise=base.noise, spans=spans)
    merged = checkpointed(E.merge_beats(device=base.beats, inserted=inserted, labels=labels))
    # A sinus beat with a label by hand is audited, too: for its measures, as the label decides the verdict.
    by_hand = base.beats.filter("label = 'N'").join(labels.select("record_id", "t_ms"), ["record_id", "t_ms"], "left_semi").select("record_id", "k", "t_ms")
    measures, sampled, noise_base, rhythm = base.known
    more = measures.unionByName(G.beat_measures(around(signal, by_hand, fs), by_hand.join(measures, ["record_id", "k"], "left_anti"), fs, mv, lengths))
    features = base.features.unionByName(audit_features(base.beats, more, sampled, noise, noise_base, rhythm, by_hand))
    audit = checkpointed(E.effective_audits(beat=merged, audit=reaudited(base, spans), features=features))
    rr = checkpointed(R.rr(beat=merged))
    gaps, missing = X.long_intervals(rr=rr), X.missed_candidates(rr=rr, context=R.rr_context(rr=rr))
    both = gaps.unionByName(missing)
    checks = checkpointed(G.interval_checks(signal, both.join(base.calibration, "record_id"), fs, mv, "qrs_amp_mv", "noise_base_ii_mv").select("record_id", "k", "gap_bad", "gap_reason", "missed"))
    noise_at = X.noise_at(interval=both, noise=noise)
    episodes = X.ep_order(
        pause=X.ep_pause(interval=gaps, noise_at=noise_at, checks=checks), v_run=X.ep_v_run(audit=audit), v_run_rejected=X.ep_v_run_rejected(audit=audit), s_run=X.ep_s_run(audit=audit, sinus=X.sinus_before(rr=rr)),
        missed=X.ep_missed(interval=missing, noise_at=noise_at, checks=checks), noise=X.ep_noise(noise=noise),
    )
    return Edited(merged, noise, audit, episodes)
