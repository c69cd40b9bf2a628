import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pulseforge.llm import cotraining, exact_dedup, mixing, repetition, url_filters
from pulseforge.llm.exact_dedup import QuotientFilter

from .shared import AWKWARD, documents, empty


def test_quotient_filter_merges_without_loss():
    r = np.random.default_rng(1)
    pool = np.unique(r.integers(0, 2**62, 3000).astype(np.uint64))
    counts = Counter()
    filters = []
    for size in (0, 1, 400, 2500):
        low, n = np.unique(r.choice(pool, size), return_counts=True)
        counts.update(dict(zip(low.tolist(), n.tolist(), strict=True)))
        filters.append(QuotientFilter.from_bytes(QuotientFilter.build(low, n, 46).to_bytes()))
    low, n = QuotientFilter.merge(filters).items()
    assert dict(zip(low.tolist(), n.tolist(), strict=True)) == dict(counts) and (np.diff(low.astype(float)) > 0).all()


def same_text(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    return groups


def test_exact_dedup(spark, monkeypatch):
    rows = [*AWKWARD, *[(200 + k, "a  copy\nof it" if k % 3 else "a copy of it", "en", "s") for k in range(60)]]
    for bound in (10**6, 0):  # a broadcast, and a shuffle beyond its bound
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", bound)
        got = exact_dedup.exact_dedup(documents(spark, rows, 7)).collect()
        want = []
        for text, ids in same_text(rows).items():
            keep = min((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    kept = exact_dedup.deduplicated(documents(spark, rows)).collect()
    assert len(kept) == len(same_text(rows)) and {r["doc_id"] for r in kept} == {min((i for i in ids if i is not None), default=None) for ids in same_text(rows).values()}
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def filled(sizes, share=1.5, most=2):
    """Targets by raising shares and capping until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, done = share * sum(sizes.values()), {}
    while True:
        left, pool = total - sum(done.values()), [s for s in order if s not in done]
        given = {s: left * weight[s] / sum(weight[x] for x in pool) for s in pool}
        over = [s for s in pool if given[s] > most * sizes[s]]
        if not over:
            return done | given
        done |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = np.random.default_rng(seed)
    rows = [*AWKWARD, *[(300 + k, " ".join(["w"] * int(r.integers(0, 900))), "en", None if k % 7 == 0 else f"s{int(r.integers(0, 9)) if k % 3 else 0}") for k in range(260)]]
    docs = documents(spark, rows, 6)
    got = mixing.mix_summary(docs).collect()
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").encode().split())
    targets, taken = filled(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for x in got:
        assert abs(x["target"] - targets[x["source"]]) < 1e-6 * max(1, x["target"]) and x["source_size"] == sizes[x["source"]]
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.03 * target + 3 * mixing.BLOCK_WORDS
    again = mixing.mix_summary(docs.repartition(2)).collect()
    assert sorted((str(x["doc_id"]), x["taken"]) for x in got) == sorted((str(x["doc_id"]), x["taken"]) for x in again)
    assert mixing.mix_summary(empty(spark)).collect() == []
    # The mix by document holds as many words as were taken.
    mixed = mixing.mixed_documents(docs.drop("fp", "part", "rank", "size").filter("doc_id <> 8")).collect()
    words = Counter()
    for x in mixed:
        words[x["doc_id"]] += len(x["text"].split())
        assert x["n_chars"] == len(x["text"]) > 0
    assert set(words) <= {x["doc_id"] for x in got}
    total = sum(words.values())
    assert abs(total - 1.5 * sum(v for v in sizes.values())) < 0.03 * total + 500


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 1000, 4099):
        index = np.arange(size)
        out = mixing.permuted(index, np.full(size, size), np.full(size, 12345, np.uint64))
        assert sorted(out.tolist()) == list(range(size))


def repeats(text):
    """The rules' counts from their definitions."""
    words = (text or "").encode().split()
    chars = [len(w.decode()) for w in words]
    out = {"n_words": len(words), "word_chars": sum(chars), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    dup = [x for k, x in enumerate(lines) if x in lines[:k]]
    out |= {"n_lines": len(lines), "line_chars": sum(map(len, lines)), "n_dup_lines": len(dup), "dup_line_chars": sum(map(len, dup))}
    for n in (3, *repetition.NGRAM_PERCENT):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, seen, inside = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1 if n == 3 else g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        out["n_repeat_words" if n == 3 else f"dup_chars_{n}"] = len(inside) if n == 3 else sum(chars[i] for i in inside)
    return out


def test_quality_rules(spark):
    r = np.random.default_rng(3)
    rows = [row for row in AWKWARD if len(row[1] or "") < 100_000] + [(400 + k, " ".join(r.choice(["aa", "b", "ccc", "é", "dd\n"], 160 if k % 2 else 40, p=[0.3, 0.3, 0.2, 0.1, 0.1])), "en", "s") for k in range(40)]
    rows += [(500 + k, " ".join(f"w{int(x)}" for x in r.integers(0, 10**6, 90)) + " " + "tail of ten words that comes again and again here " * (k % 5), "en", "s") for k in range(20)]
    got = repetition.quality_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for row in rows:
        texts[row[0]] = row[1]
    for x in got:
        want = repeats(texts[x["doc_id"]])
        assert {k: x[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        bad = 100 * want["n_dup_lines"] > 30 * want["n_lines"] or 100 * want["dup_line_chars"] > 20 * want["line_chars"] or any(100 * want[f"dup_chars_{n}"] > p * want["word_chars"] for n, p in repetition.NGRAM_PERCENT.items())
        assert (x["base_failed"], x["kept"]) == (failed, not failed and not bad)
    assert any(x["kept"] for x in got) and repetition.quality_rules(empty(spark)).collect() == []


def test_url_filters(spark, monkeypatch):
    entries = spark.createDataFrame(
        [("example.com", "block", "2024-01-10"), ("a.example.com", "allow", "2024-02-01"), ("a.example.com", "remove", "2024-03-01"), ("a.example.com/x/", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("b.org", "block", None)], "key string, action string, day string"
    ).selectExpr("key", "action", "cast(day as date) day")
    cases = [
        (1, "http://a.example.com/y", "2024-01-09", "allow"), (2, "http://a.example.com/y", "2024-01-10", "block"), (3, "https://u@A.Example.com:80/y?q", "2024-02-01", "allow"), (4, "http://a.example.com/x/y", "2024-02-10", "block"),
        (5, "http://a.example.com/x", "2024-02-10", "allow"), (6, "http://a.example.com/", "2024-03-01", "block"), (7, None, "2024-03-01", "invalid"), (8, "nonsense", "2024-03-01", "invalid"), (9, "http://b.org/", "2024-03-01", "allow"),
        (9, "http://b.org/", "2024-03-01", "allow"), (10, "http://example.com", None, "allow"), (None, "http://z.example.com", "2024-03-01", "block"),
    ]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c, _ in cases], "page_id long, url string, f string, key int").selectExpr("page_id", "url", "cast(f as date) fetched", "key")
    for bound in (10**6, 0):
        monkeypatch.setattr(url_filters, "BROADCAST_ROWS", bound)
        got = url_filters.evaluate(pages, entries).collect()
        assert sorted((str(x["page_id"]), x["decision"]) for x in got) == sorted((str(a), d) for a, _, _, d in cases)
        assert all(x["kept"] == (x["decision"] == "allow") for x in got)
    assert url_filters.evaluate(pages.limit(0), entries).collect() == []
    assert {x["decision"] for x in url_filters.evaluate(pages, entries.limit(0)).collect()} == {"allow", "invalid"}


def test_url_filters_of_deep_paths(spark):
    entries = spark.createDataFrame([("h.org/a/b/c/d/e/", "block"), ("h.org/a/b/c/d/", "allow"), ("h.org", "block"), ("g.org/1/2/3/4/", "block")], "key string, action string").selectExpr("*", "date'2024-01-01' AS day")
    cases = {"http://h.org/a/b/c/d/e/f/g.html": "h.org/a/b/c/d/e/", "http://h.org/a/b/c/d/x/": "h.org/a/b/c/d/", "http://h.org/a/b/c/d": "h.org", "http://g.org/1/2/3/4/?q=/5/": "g.org/1/2/3/4/", "http://g.org/1/2/3/5/": None}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").selectExpr("*", "date'2024-02-01' AS fetched")
    got = url_filters.evaluate(pages, entries).orderBy("page_id").collect()
    assert [x["decided_by"] for x in got] == list(cases.values())
    assert [x["decision"] for x in got] == ["block", "allow", "block", "block", "allow"]


def test_cotraining(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    even = labels.filter("doc_id % 2 = 0")
    rows = cotraining.quality_scores(docs, even).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad).mean() > 0.9 and (good >= 0.5).mean() > 0.9
    got = cotraining.quality_scores(documents(spark), labels.limit(0)).collect()
    assert len(got) == len(AWKWARD) and all(r["score"] == 0.5 for r in got)
    known = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (6, 0), (7, 0), (None, 1)], "doc_id long, quality int")
    assert len(cotraining.quality_scores(documents(spark), known).collect()) == len(AWKWARD)
    assert cotraining.quality_scores(empty(spark), labels).collect() == []


def test_cotraining_samples_are_bounded(spark, monkeypatch):
    """A third of the rows has no id, a third one and the same labelled id, and some rows are equal."""
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(3000)]
    rows = [(i, "equal rows" if k % 10 == 0 else f"text {k} of many", "en", f"s{k % 4}") for k, i in enumerate(ids)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i == 7 else 0) for i in sorted({i for i in ids if i} - set(range(1500, 3000)))], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(cotraining, "CoTrained", lambda content, meta, label, pick: seen.append((label, meta)))
    for bound in (10**6, 0):
        monkeypatch.setattr(cotraining, "BROADCAST_ROWS", bound)
        cotraining.fit(docs, labels, fit_labelled=300)
    cotraining.fit(docs.repartition(9), labels, fit_labelled=300)
    for label, meta in seen:
        n = Counter(label.tolist())
        assert 100 < n[1] < 200 and 100 < n[0] < 200 and n[-1] == 0
        assert (label == seen[0][0]).all() and (meta == seen[0][1]).all()
    cotraining.fit(docs, labels, fit_labelled=10**6)
    assert Counter(seen[-1][0].tolist()) == {1: 1000, 0: 500}


def test_cotraining_rounds_search_all_unlabelled_rows(spark):
    """The rounds' pseudo-labels, and the models they lead to, against a search in memory that sorts all rows."""
    r = random.Random(3)
    good, bad = "the house and garden were seen by them on a sunny day".split(), "$$$ click !!! ### WIN %%% now &&& ||| ***".split()
    rows = []
    for k in range(400):
        some = r.choices(good, k=r.randrange(3, 40)) + r.choices(bad, k=r.randrange(0, 30) if k % 2 else 0)
        rows.append((k if k % 5 else None, " ".join(some), r.choice(["en", "de"]), f"s{k % 2 if r.random() < 0.8 else 2}"))
    rows += rows[300:330] * 3  # equal rows
    docs = documents(spark, rows, 7)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120) if k % 5], "doc_id long, quality int")
    model = cotraining.fit(docs, labels)
    hashed = docs.select(cotraining.row_hash("doc_id", "text", "source", "lang").alias("row"), "text", "source", "lang", "doc_id").collect()
    chars = lambda x: np.array([len((t.text or "").encode()) for t in x], float)
    rounded = lambda m: m.astype(np.float16).astype(np.float32)
    pool = [x for x in hashed if x.doc_id is None or x.doc_id >= 120]
    content = rounded(cotraining.content_features([(x.text or "").encode() for x in pool]))
    meta = rounded(cotraining.meta_features([x.source for x in pool], [x.lang for x in pool], chars(pool)))
    hashes = [x.row for x in pool]

    def pick(models, low, up, gone):
        out = []
        for k, m in enumerate(models):
            logit = m.logit((content, meta)[k])
            distinct = {h: (float(v), j) for j, (h, v) in enumerate(zip(hashes, logit, strict=True)) if h not in set(gone.tolist())}
            lows, highs = (sorted(distinct, key=lambda h: (s * distinct[h][0], h))[:n] for s, n in ((1, low), (-1, up)))
            out.append(tuple((np.array(x, np.int64), content[[distinct[h][1] for h in x]], meta[[distinct[h][1] for h in x]]) for x in (lows, highs)))
        return out

    known = {k: 1 - k % 2 for k in range(120) if k % 5}
    sample = sorted((x for x in hashed if x.doc_id in known), key=lambda x: cotraining.pd.util.hash_array(np.array([x.row]))[0])
    again = cotraining.CoTrained(
        rounded(cotraining.content_features([x.text.encode() for x in sample])), rounded(cotraining.meta_features([x.source for x in sample], [x.lang for x in sample], chars(sample))), np.array([known[x.doc_id] for x in sample]), pick
    )
    assert len(model.taken) == cotraining.ROUNDS
    sets = lambda taken: [[[sorted(part.tolist()) for part in sides] for sides in one] for one in taken]
    assert sets(model.taken) == sets(again.taken)
    for a, b in zip(model.scores(content, meta), again.scores(content, meta), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_thresholds_are_fractions():
    from pulseforge.llm.ngram_join import enough

    assert enough(90, 100, 90, Fraction(9, 10)) and not enough(89, 100, 90, Fraction(9, 10))


def test_slots_beyond_a_sources_room_are_drawn_again(spark):
    draws = spark.createDataFrame([(0, 0, 30), (0, 1, 10), (1, 0, 25), (1, 1, 15)], "shard long, rank int, drawn long")
    targets = [(0, 1600.0, 25), (1, 900.0, 100)]  # words and blocks: source 0 has room for 50 slots
    got = mixing.with_room(draws, targets, 32, 2).collect()
    assert sorted((r["shard"], r["rank"], r["drawn"]) for r in got)[4:] == [(2, 1, 5)]
    blocks = spark.createDataFrame([(0, 25), (1, 100)], "rank int, blocks long")
    slots = mixing.mixed_slots(mixing.with_room(draws, targets, 32, 2), blocks, 1).collect()
    assert len(slots) == 80 and max(Counter((s["rank"], s["block"]) for s in slots).values()) <= 2


def test_slots_take_one_python_worker_a_task(spark):
    """Blocks of slots by plain code, from plans in which no stage asks two Python workers at once and none comes of Python rows."""
    draws = spark.sql("SELECT * FROM VALUES (0L, 0, 30L), (0L, 1, 10L), (1L, 0, 25L), (1L, 1, 15L) AS t(shard, rank, drawn)")
    blocks = spark.range(2).selectExpr("cast(id AS int) AS rank", "if(id = 0, 25L, 100L) AS blocks")
    roomy = mixing.with_room(draws, [(0, 1600.0, 25), (1, 900.0, 100)], 32, 2)
    slots = mixing.mixed_slots(roomy, blocks, 1)
    pieces = spark.range(200).selectExpr("cast(id % 2 AS int) AS rank", "id div 2 AS block", "0 AS part", "id AS pos", "32L AS words", "0L AS word0")
    made = mixing.Mix(None, pieces, slots)
    for df in (made.taken(), made.pieces()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("MapInArrow|EvalPython|MapInPandas", plan)) == 1
    assert "ExistingRDD" not in roomy._jdf.queryExecution().executedPlan().toString()
    want, first = [], Counter()
    for shard, rank, drawn in [(0, 0, 30), (0, 1, 10), (1, 0, 20), (1, 1, 15), (2, 1, 5)]:
        size = (25, 100)[rank]
        for slot in range(drawn):
            epoch, at = divmod(first[rank] + slot, size)
            block = mixing.permuted(np.array([at]), np.array([size]), np.array([mixing.seed_of(1, rank, epoch)], np.uint64))
            want.append((shard, slot, rank, int(block[0])))
        first[rank] += drawn
    assert sorted(map(tuple, slots.collect())) == sorted(want)


def test_repetition_of_very_long_texts():
    """Counts of a text of two million characters, whose repeats are known."""
    line = " ".join(f"w{k}" for k in range(200_000))
    found = repetition.repetition([f"{line}\nunlike all\n{line}".encode()])[0]
    assert found[0] == 400_002 and found[3] == 1 and found[4] == 400_000


def test_cotraining_scores_against_plain_code():
    """Scores of the fitted views against the sums that define them, and rounds that only add rows of the pool."""
    r = np.random.default_rng(2)
    label = np.where(np.arange(400) < 200, r.integers(0, 2, 400), -1)
    truth = np.where(label >= 0, label, r.integers(0, 2, 400))
    content, meta = r.normal(truth[:, None], 1.0, (400, 5)), r.normal(truth[:, None], 1.2, (400, 3))
    known, rest = label >= 0, np.flatnonzero(label < 0)

    def pick(models, low, up, gone):
        part = lambda at: (rest[at], content[rest[at]], meta[rest[at]])
        left = np.flatnonzero(~np.isin(rest, gone))
        order = [left[np.argsort(m.logit(x[rest[left]]), kind="stable")] for m, x in zip(models, (content, meta), strict=True)]
        return [(part(o[:low]), part(o[-up:])) for o in order]

    model = cotraining.CoTrained(content[known], meta[known], label[known], pick, rounds=2, per_round=20)
    logits = []
    for (view, line), x in zip(model.views, (content, meta), strict=True):
        own = []
        for row in x:
            z = [min(4.0, max(-4.0, (v - m) / s)) for v, m, s in zip(row, view.mean, view.scale, strict=True)]
            own.append(line.a * min(20.0, max(-20.0, sum(a * b for a, b in zip(z, view.coef, strict=True)) + view.bias)) + line.b)
        logits.append(np.array(own))
    for got, want in zip(model.scores(content, meta), (logits[0], logits[1], (logits[0] + logits[1]) / 2), strict=True):
        assert np.allclose(got, 1 / (1 + np.exp(-want)), atol=1e-6)
    assert ((model.scores(content, meta)[2] > 0.5) == (truth > 0)).mean() > 0.85
