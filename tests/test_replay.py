"""A reviewer's edits replayed beat by beat in plain Python, and what the review queries make of them."""

import random
from collections import Counter, defaultdict

import pytest

from pulseforge.operators import edits as E
from pulseforge.operators import summary as S
from pulseforge.operators import views as V
from pulseforge.plans import catalog
from pulseforge.sources import bindings as B

SF = "/root/testdata/sf0.001"
KEPT = ("likely", "uncertain", "manual")


@pytest.fixture(scope="module")
def replay(spark):
    """The inputs as rows, and the effective audits made of them one beat after another."""
    p, made = catalog.review_plans(), {}
    merge, effective = p["merge_beats"], p["effective_audits"]
    for name in ("merge_beats", "effective_audits", "ep_order", "summary"):
        p[name].frame(spark, SF, made)
        p[name].written(made)
    rows = lambda plan: [r.asDict() for r in plan.frame(spark, SF, made).collect()]
    beats = sorted(rows(B.long_records), key=lambda b: (b["record_id"], b["k"]))
    labels = {(r["record_id"], r["t_ms"]): r["label"] for r in rows(merge.inputs["labels"])}
    inserted = rows(merge.inputs["inserted"])
    audits = {(a["record_id"], a["k"]): a for a in rows(effective.inputs["audit"])}
    features = {(f["record_id"], f["k"]): f for f in rows(effective.inputs["features"])}
    merged = sorted([(b["record_id"], b["t_ms"], 0, b["k"], b["label"]) for b in beats] + [(i["record_id"], i["t_ms"], 1, -1, i["label"]) for i in inserted])
    out, ks, relabelled = [], Counter(), set()
    for record, t, _, origin, label in merged:
        k = ks[record]
        ks[record] += 1
        by_hand = None if (record, t) in relabelled else labels.get((record, t))
        relabelled.add((record, t))
        new = label if origin < 0 and by_hand is None else by_hand
        a = audits.get((record, origin))
        if new is None and a is None:
            out.append({"record_id": record, "k": k, "t_ms": t, "label": label, "audit": None})
            continue
        f = features.get((record, origin))
        audit = {"family": -1 if a is None or a["family"] is None else a["family"], "noise_ratio": None if f is None or f["edge"] else f["noise_ratio"]}
        if new is None:
            audit |= {"verdict": a["verdict"], "confidence": a["confidence"]}
        else:
            audit |= {"verdict": "manual" if new in "VS" else "manual-N" if new == "N" else "manual-X", "confidence": 1.0}
        out.append({"record_id": record, "k": k, "t_ms": t, "label": label if new is None else new, "audit": audit})
    return p, made, rows, beats, labels, audits, out


def test_effective_audits(replay):
    p, _, rows, _, _, _, out = replay
    got = {(r["record_id"], r["k"]): (r["t_ms"], r["label"], r["verdict"], r["confidence"], r["family"], r["noise_ratio"]) for r in rows(p["effective_audits"])}
    want = {(b["record_id"], b["k"]): (b["t_ms"], b["label"], *(b["audit"][c] for c in ("verdict", "confidence", "family", "noise_ratio"))) for b in out if b["audit"]}
    assert got == want
    assert sum(v[2].startswith("manual") for v in want.values()) > 50 and any(v[4] >= 0 and v[2] == "manual" for v in want.values())


def test_counts_and_cards(replay):
    p, _, rows, beats, labels, _, out = replay
    device, kept = Counter(b["label"] for b in beats), [b for b in out if b["audit"] and b["audit"]["verdict"] in KEPT]
    rejected = Counter(b["label"] for b in out if b["audit"] and b["audit"]["verdict"] not in KEPT)
    assert len({b["record_id"] for b in beats}) == 1
    s = rows(p["summary"])[0]
    assert (s["device_n"], s["device_v"], s["device_s"], s["beats"]) == (device["N"], device["V"], device["S"], len(out))
    assert s["duration_s"] == round(beats[-1]["t_ms"] / 1000, 1)
    v = [b for b in kept if b["label"] == "V"]
    likely = sum(b["audit"]["verdict"] in ("likely", "manual") for b in v)
    cards = {(r["card"], r["name"]): r["value"] for r in rows(p["stats_cards"])}
    assert [cards["v", n] for n in ("device", "kept", "likely", "uncertain", "rejected")] == [device["V"], len(v), likely, len(v) - likely, rejected["V"]]
    assert [cards["s", n] for n in ("device", "kept", "rejected")] == [device["S"], sum(b["label"] == "S" for b in kept), rejected["S"]]
    episodes = rows(p["ep_order"])
    runs = lambda kind: [e for e in episodes if e["kind"] == kind]
    real = lambda es: sum(e["verdict"] != "artifact" for e in es)
    times = [b["t_ms"] for b in out]
    pauses = sum(y - x > 2000 for x, y in zip(times, times[1:], strict=False))
    want = [(device["V"], len(v)), (device["S"], sum(b["label"] == "S" for b in kept)), (len(runs("v-run")), real(runs("v-run"))), (len(runs("s-run")), real(runs("s-run"))), (pauses, real(runs("pause")))]
    assert [(r["before"], r["after"]) for r in sorted(rows(p["dumbbell"]), key=lambda r: r["place"])] == want
    hours = Counter(b["t_ms"] // 3_600_000 for b in v)
    assert {r["b"]: r["v"] for r in rows(p["hourly_sums"])} == {h: hours.get(h, 0) for h in range(beats[-1]["t_ms"] // 3_600_000 + 1)}
    assert [(r["hour"], r["v"]) for r in rows(p["peak_hour"])] == [min(hours.items(), key=lambda x: (-x[1], x[0]))]


def test_strips(replay):
    p, _, rows, _, _, _, out = replay
    episodes = [e for e in rows(p["ep_order"]) if e["verdict"] != "artifact"]
    in_run = {k for e in episodes if e["kind"] in ("v-run", "s-run") for k in range(e["k0"], e["k1"] + 1)}
    kept = [b for b in out if b["audit"] and b["audit"]["verdict"] in KEPT]
    families = Counter(b["audit"]["family"] for b in kept if b["label"] == "V" and b["audit"]["family"] >= 0)
    shapes = sorted(((n, f) for f, n in families.items() if n >= 3), reverse=True)
    assert [(r["n"], r["family"]) for r in sorted(rows(p["morphologies"]), key=lambda r: r["place"])] == shapes
    rank = lambda b: (b["k"] not in in_run, b["audit"]["verdict"] == "manual", -(b["audit"]["noise_ratio"] or 0), b["audit"]["confidence"], -b["k"])
    got = rows(p["strip_rank"])
    assert len(got) == len(kept) and {r["k"] for r in got if r["in_run"]} == in_run & {b["k"] for b in kept} != set()
    strips = {r["id"]: r for r in rows(p["auto_strips"])}
    for place, (n, family) in enumerate(shapes[:4], 1):
        best = max((b for b in kept if b["label"] == "V" and b["audit"]["family"] == family), key=rank)
        assert strips[f"pvc-{family}"]["beat"] == best["k"] and strips[f"pvc-{family}"]["caption"] == f"Желудочковая экстрасистола, морфология {place} ({n} за сутки)"
    assert strips["sve"]["beat"] == max((b for b in kept if b["label"] == "S"), key=rank)["k"]
    assert "sinus" in strips


def test_families_by_hand_and_by_audit(spark):
    """Drawers and sentences of families, with labels by hand on few of them."""
    r = random.Random(7)
    family = [(0, k, k * 800, r.choice("NNVVS") if k % 13 > 3 else "NV"[k % 13 % 2], k % 13) for k in range(600)]
    verdicts = {k: r.choice(["likely", "uncertain", "noisy", "narrow"] if f % 2 else ["likely"] * 9 + ["noisy"]) for _, k, _, label, f in family if label != "N"}
    verdicts |= {k: "noisy" for k in verdicts if k % 13 == 3}
    labels = [(0, t, r.choice("VNSX")) for _, k, t, _, f in family if f in (5, 6) and r.random() < 0.3]
    members = spark.createDataFrame(family, "record_id long, k long, t_ms long, label string, family long")
    audit = spark.createDataFrame([(0, k, v) for k, v in verdicts.items()], "record_id long, k long, verdict string")
    by_hand = S.hand_labels(family=members, labels=spark.createDataFrame(labels, "record_id long, t_ms long, label string"))
    score = S.family_score(family=members, audit=audit, by_hand=by_hand).cache()
    text = {x["family"]: x["text"] for x in V.verdict_text(score=score, reasons=V.top_reason(summary=S.family_summary(family=members, audit=audit))).collect()}
    hand, own = dict((t, x) for _, t, x in labels), defaultdict(list)
    for _, k, t, label, f in family:
        own[f].append((k, t, label))
    buckets = set()
    for x in score.collect():
        mine = own[x["family"]]
        set_by = list(dict.fromkeys(hand[t] for _, t, _ in mine if t in hand))
        number = Counter(hand[t] for _, t, _ in mine if t in hand)
        v = [verdicts[k] for k, _, label in mine if label == "V"]
        kept, unsure, s = sum(y in KEPT for y in v), v.count("uncertain"), sum(label == "S" for *_, label in mine)
        if set_by:
            top = max(set_by, key=lambda y: number[y])
            want, said = {"V": "v", "S": "s"}.get(top, "n"), "врач: " + " · ".join(f"{y} {number[y]}" for y in set_by)
        else:
            want = "decide" if len(v) >= 3 and (unsure >= 3 or 0.2 <= kept / len(v) <= 0.8) else "v" if len(v) >= 3 and kept / len(v) > 0.8 else "v" if len(v) > len(mine) / 2 else "s" if s > len(mine) / 2 else "n"
            if not v:
                said = f"форма синусовая; {s} ранних (НЖЭС) по времени" if s else "синусовая форма"
            elif kept == len(v):
                said = f"ЖЭС: аудит подтверждает все {len(v)}"
            elif not kept:
                said = f"не ЖЭС: все {len(v)} метки V отклонены (в помехе)"
            else:
                said = f"ЖЭС? подтверждено {kept} из {len(v)}, отклонено {len(v) - kept}"
        assert (x["bucket"], text[x["family"]]) == (want, said), x
        buckets.add(want)
    assert len(buckets) >= 3


def test_verbs(spark):
    """Labels by merged index, for the device's beats and inserted ones; entries of a diary number by record."""
    device = spark.createDataFrame([(r, k, k * 1000, "N") for r in (1, 2) for k in range(3)], "record_id long, k long, t_ms long, label string")
    log = spark.createDataFrame([], "record_id long, t_ms long, seq long, label string")
    inserted = E.add_beat(spark.createDataFrame([], "record_id long, t_ms long, label string"), device, 1, 1500, "V")
    state = lambda a, b: E.merge_beats(device=device, inserted=b, labels=E.latest_labels(log=a))
    shown = lambda a, b: [(x["t_ms"], x["label"]) for x in state(a, b).filter("record_id = 1").orderBy("k").collect()]
    assert shown(log, inserted) == [(0, "N"), (1000, "N"), (1500, "V"), (2000, "N")]
    log, inserted = E.annotate(log, inserted, state(log, inserted), 1, 2, "S")
    log, inserted = E.annotate(log, inserted, state(log, inserted), 1, 3, "V")
    assert shown(log, inserted) == [(0, "N"), (1000, "N"), (1500, "S"), (2000, "V")]
    log, inserted = E.annotate(log, inserted, state(log, inserted), 1, 3, None)
    log, inserted = E.annotate(log, inserted, state(log, inserted), 1, 2, None)
    assert shown(log, inserted) == [(0, "N"), (1000, "N"), (2000, "N")]
    for k, label, error in ((3, "V", IndexError), (-1, "V", IndexError), (0, "Q", ValueError)):
        with pytest.raises(error):
            E.annotate(log, inserted, state(log, inserted), 1, k, label)
    diary = spark.createDataFrame([], "record_id long, id long, t_ms long, text string")
    for record, t in ((1, 5), (2, 7), (1, 9)):
        diary = E.add_event(diary, record, t, " x ", 2000)
    assert sorted(tuple(x) for x in diary.collect()) == [(1, 1, 5, "x"), (1, 2, 9, "x"), (2, 1, 7, "x")]
    assert sorted(tuple(x)[:2] for x in E.remove_event(diary, 1, 1).collect()) == [(1, 2), (2, 1)]
    for t in (-1, 2001):
        with pytest.raises(ValueError):
            E.add_event(diary, 1, t, "x", 2000)
