import hashlib
import re

import pytest

from pulseforge.llm import decontamination

from .shared import AWKWARD, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "The cat sat on, the MAT the cat sat on the mat!"),
    (2, "läuft schnell"),
    (3, None),
    (4, " ... "),
    (5, "hello"),
    (6, "a b c d e f g h"),
    (7, "one two three four five six seven eight nine"),
    (8, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (9, "three four five six seven eight nine ten eleven twelve"),
    (9, "ein zwei drei vier fünf"),
    (10, "word word word word word word word word word word word"),
    (None, "x y z"),
    (11, "Ärger mit Ä"),
]
DOCS = [
    (20, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen. Hello!", "en", "a"),
    (21, "one, two; three four five six seven eight nine", "en", "a"),
    (22, "x a b c d e f g a b c d e f g h h a b c d e f g h", "en", "a"),
    (23, "ein zwei drei vier fünf sechs x y z", "de", "a"),
    (24, "two three four five six seven eight nine ten", "en", "a"),
    (25, "ärger mit ä, Ärger mit Ä", "de", "a"),
    *[(k, "--one two three four five six seven eight nine ten eleven, and hello", "en", "hot") for k in range(30, 60)],
    (30, "--one two three four five six seven eight nine ten eleven, and hello", "en", "hot"),
]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10):
    own, hit, ids = words(text), set(), set()
    for item, said in items:
        w = words(said)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[a : a + n]:
                    hit.update(range(at, at + n))
                    ids.add(item)
    ids = sorted(str(x) for x in ids if x is not None)
    return len(own), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, seed string, n int")


@pytest.mark.parametrize("window", [10, 4])
def test_hits_of_every_row(spark, window, monkeypatch):
    rows = [*AWKWARD, *DOCS]
    want = sorted((repr(d), n, len(hit), k, sha, bool(hit)) for d, text, *_ in rows for n, hit, k, sha in [plain(text, ITEMS, window)])
    for bound in (decontamination.SEED_ROWS, 0):  # broadcast and shuffled
        monkeypatch.setattr(decontamination, "SEED_ROWS", bound)
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
        got = decontamination.contamination(documents(spark, rows), benchmark(spark), window)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == want


def test_rows_and_spans_removed(spark):
    rows = [*AWKWARD, *DOCS]
    docs, items = documents(spark, rows), benchmark(spark)
    kept = decontamination.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((repr(d), t or "") for d, t, *_ in rows if not plain(t, ITEMS)[1])
    cut = decontamination.cleaned_texts(docs, items)
    assert cut.columns == docs.columns

    def without(text):
        hit = plain(text, ITEMS)[1]
        if not hit:
            return text
        head = re.match(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text)[0]
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text)
        return head + "".join(t for k, t in enumerate(tokens) if k not in hit)

    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in cut.collect()) == sorted((repr(d), repr(without(t))) for d, t, *_ in rows)


def test_nothing_to_find(spark):
    assert decontamination.contamination(empty(spark), benchmark(spark)).count() == 0
    for items in (benchmark(spark).limit(0), benchmark(spark, [(1, None), (2, "--")])):
        got = decontamination.contamination(documents(spark), items).collect()
        assert len(got) == len(AWKWARD)
        assert all((r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) == (0, 0, False, hashlib.sha256(b"").hexdigest()) for r in got)
        assert decontamination.cleaned_texts(documents(spark), items).count() == len(AWKWARD)


def test_long_text(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    rows = [(1, long, "en", "a"), (2, long + " one two three four five six seven eight nine", "en", "a")]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination(documents(spark, rows), benchmark(spark)).collect()}
    assert got == {1: (300_000, 0), 2: (300_009, 9)}
