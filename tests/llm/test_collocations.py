import random
import re
from collections import Counter

import numpy as np
import pytest

from pulseforge.llm import collocations

from .shared import AWKWARD, documents, empty


def plain(rows, least, top=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), longer in candidates.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                if 100 * longer >= cover * f[lang, g[i : i + m]]:
                    gone.add((lang, g[i : i + m]))
    out = []
    for lang in n:
        kept = []
        for (own, g), a in candidates.items():
            if own == lang and (own, g) not in gone:
                cuts = [(2_000_000 * a // (f[own, g[:k]] + f[own, g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(g).encode(), f[own, g[:k]], f[own, g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "new", "york", "city", "times", "Ünï", "x\x01", "x", "and", "a", "über", "\x00z"]
    weights = [9, 8, 3, 3, 2, 1, 1, 1, 1, 3, 4, 1, 1]
    rows = []
    for k in range(n):
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", " . "]) for w in r.choices(vocabulary, weights, k=r.randrange(60)))
        if k % 3 == 0:
            text += " New York City Times, san francisco bay area san francisco"
        rows.append((k, text, r.choice(["en", "en", "de", None]), "a"))
    return rows


@pytest.mark.parametrize("words", [300_000, 5])
def test_against_plain_counts(spark, monkeypatch, words):
    for name, value in (("BROADCAST_ROWS", words), ("BLOCK_KEYS", 700), ("RANGE_KEYS", 300), ("SAMPLE_KEYS", 32), ("HELD_WORDS", 20)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(240, 3) + AWKWARD
    got = sorted(tuple(r) for r in collocations.collocations(documents(spark, rows), least=6, top=40).collect())
    want = plain([(r[2], r[1]) for r in rows], 6, 40)
    assert len(want) > 60
    assert got == want


def test_whole_sizes(spark):
    rows = corpus(200, 4)
    df = collocations.collocations(documents(spark, rows))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in df.collect()) == plain([(r[2], r[1]) for r in rows], 30)


def test_nothing(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    assert collocations.collocations(documents(spark, [(1, "one two three", "en", "a"), (2, None, None, None)])).collect() == []


def test_radix_order():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 3, 500).astype(np.uint64) << np.uint64(40), r.integers(0, 2**63, 500).astype(np.uint64)]
    assert collocations.radix_order(columns).tolist() == sorted(range(500), key=lambda k: (columns[0][k], columns[1][k]))
    assert collocations.radix_order([np.zeros(0, np.uint64)]).tolist() == []
