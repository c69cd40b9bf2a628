import math
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from pulseforge.llm import language_id, piece_codec, token_store
from pulseforge.llm.lattice import SPACE, Lattices, n_best, pieces_of, scaled_sums

from .shared import AWKWARD, documents, empty

VOCABULARY = P.path("piece_bpe_32k.model")


def all_paths(pieces, word):
    """Every segmentation of word: (score, ids)."""
    out = {0: [(0.0, [])]}
    edges = pieces.edges(word)
    for end in range(1, len(word) + 1):
        out[end] = [(s + pieces.edge_score(word, e), [*ids, *pieces.spell(word, e)]) for e in edges if e[1] == end for s, ids in out[e[0]]]
    return sorted(out[len(word)], key=lambda x: -x[0])


def test_n_best_against_all_paths():
    pieces = pieces_of(VOCABULARY)
    for word in ("▁the", "▁streets", "a", "▁你好x", "𝔘", "▁▁▁and", "thththe,"):
        every = all_paths(pieces, word)
        for n in (1, 3, 10):
            found = n_best(pieces, word, n)
            assert [s for s, _ in found] == [s for s, _ in every[:n]]
            assert len({tuple(i) for _, i in found}) == len(found)
            assert all((s, i) in every for s, i in found)
    words = ["▁the", "▁streets", "a", "▁你好x"]
    x = Lattices(pieces, words)
    score = np.array([pieces.score[p] if p >= 0 else pieces.byte_score * len(words[w][a].encode()) for w, a, p in zip(x.word, x.start, x.piece, strict=True)])
    best, second, _ = x.best(score)
    for k, w in enumerate(words):
        every = all_paths(pieces, w)
        assert best[k] == every[0][0] and second[k] == (every[1][0] if len(every) > 1 else -np.inf)


def test_forward_sums_against_all_paths():
    pieces = pieces_of(VOCABULARY)
    words, prob = ["▁the", "▁sts", "▁你a"], np.random.default_rng(0).random((pieces.size + 1, 2))
    x = Lattices(pieces, words)
    alpha, beta = x.forward_sums(prob[x.piece]), x.backward_sums(prob[x.piece])
    for k, w in enumerate(words):
        total = {0: np.ones(2)}
        for end in range(1, len(w) + 1):
            total[end] = sum((total[a] * prob[p] for a, b, p in pieces.edges(w) if b == end), np.zeros(2))
        assert np.allclose(alpha[len(w), :, k], total[len(w)]) and np.allclose(beta[0, :, k], total[len(w)])


def test_codec_documents(spark):
    pieces = pieces_of(VOCABULARY)
    texts = ["an in", "the a\nto", "b  c 你", "", None, "x"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    for r in piece_codec.encode(documents(spark, rows), ["doc_id", "text"], 6).collect():
        if not r["text"]:
            assert r["ids"] == [] and r["others"] == []
            continue
        every = all_paths(pieces, SPACE + r["text"].replace(" ", SPACE))
        assert [r["score"], *[o["score"] for o in r["others"]]] == [s for s, _ in every[:6]]
        made = [piece_codec.with_edits(r["ids"], o["edits"]) for o in r["others"]]
        assert len({tuple(m) for m in [r["ids"], *made]}) == len(made) + 1
        assert all((o["score"], m) in every for o, m in zip(r["others"], made, strict=True))
    rows = piece_codec.codec_summary(documents(spark)).collect()
    assert len(rows) == len(AWKWARD) and all(r["round_trip"] for r in rows)
    assert piece_codec.codec_summary(empty(spark)).collect() == []


def expected_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_store(spark, tmp_path):
    rows = [*AWKWARD, *[(100 + k, AWKWARD[3][1] + f" tail{k}", "en", "b") for k in range(6)]]
    store = token_store.write(documents(spark, rows), f"file://{tmp_path}/s")
    back = sorted(token_store.read_back(store).collect(), key=lambda r: r["start"])
    assert all(r["verified"] for r in back)
    start = 0
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(expected_ids(r[1]))
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for r in back:
        ids = want[r["doc_id"]].pop()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    names = [bytes(r[0]) for r in store.chunks.select("digest").collect()]
    assert len(names) == len(set(names)) < sum(r["n_chunks"] for r in back)
    assert sum(r["docs"] for r in store.manifest.collect()) == len(rows)
    # A changed chunk is noticed.
    bad = store.chunks.withColumn("data", store.chunks["data"].substr(3, 10_000_000))
    store.chunks = bad
    assert not any(r["verified"] for r in token_store.read_back(store).collect())
    assert token_store.token_output(empty(spark)).collect() == []


def test_language_id(spark):
    texts = {"en": "the house and the garden were seen by them", "de": "und das Haus steht schön über der Straße", "fr": "la maison et le jardin étaient très beaux"}
    rows = [(k, f"{texts[lang]} {k}", lang, "s") for k, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 ² !!", "de", "s"), (None, texts["de"], None, "s"), (903, texts["fr"], None, None), (903, texts["fr"], None, None)]
    got = language_id.language_id(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[r[0]]["lang_pred"] == r[2] for r in rows[:60])
    assert [by[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[None]["lang_pred"] == "de" and by[None]["held_out"] and by[903]["lang_pred"] == "fr"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert language_id.language_id(empty(spark)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(documents(spark, rows[:3]).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def log_probability(pieces, word, probs):
    """Of a word, by language, in logarithms from place to place."""
    at = [[0.0] * probs.shape[1]] + [[-math.inf] * probs.shape[1] for _ in word]
    for a, b, piece in sorted(pieces.edges(word), key=lambda e: e[1]):
        for c in range(probs.shape[1]):
            x, y = at[b][c], at[a][c] + math.log(probs[piece, c])
            at[b][c] = max(x, y) + math.log1p(math.exp(min(x, y) - max(x, y)))
    return np.array(at[-1])


def test_predictions_against_plain_sums(spark):
    """Words of 30 to 60 rare letters, and others, by the posterior that the model defines."""
    langs = {"en": "the house and the garden were seen by them", "de": "und das Haus steht schön über der Straße", "zz": "ξενοδοχειο 你好世界 ありがとう"}
    docs = documents(spark, [(k, text, lang, "s") for k, (lang, text) in enumerate(list(langs.items()) * 15)])
    model = language_id.fit(docs, VOCABULARY)
    assert model.langs == ["de", "en", "zz"]
    rng, pieces = np.random.default_rng(3), pieces_of(VOCABULARY)
    texts = ["".join(rng.choice(list("你好世界ありがとうξψωжщ"), n)) for n in (1, 20, 30, 35, 36, 40, 46, 47, 48, 49, 55, 60, 400)]
    texts += ["the garden und Straße", "x" * 47, "ab " * 40, *(a + " " + b for a, b in zip(texts, texts[1:], strict=False))]
    got, score = language_id.predicted(texts, model)
    for text, lang, p in zip(texts, got, score, strict=True):
        words = language_id.units(text)
        logs = np.sum([log_probability(pieces, SPACE + w, model.probs) for w in words], axis=0)
        logs = logs / len(words) * min(len(words), language_id.SCORE_WORDS)
        odds = np.exp(logs - logs.max())
        assert lang == model.langs[int(odds.argmax())] and abs(p - 1 / odds.sum()) < 1e-6


def test_expected_pieces_of_long_words_are_those_of_short_ones():
    pieces = pieces_of(VOCABULARY)
    probs = np.random.default_rng(4).random((pieces.size + 1, 2)) * 1e-3
    for word in ("straße", "你好ありがとうξψω" * 3):
        weight = np.array([2.0, 3.0])
        both = language_id.expected_pieces(Lattices(pieces, [SPACE + word]), weight[None], probs)
        assert np.allclose(both, language_id.expected_in_long(pieces, SPACE + word, weight, probs))


def test_language_sample_is_bounded(spark):
    """A third of the rows shares one id, and a third are equal."""
    ids = next(k for k in range(1, 50) if zlib.crc32(str(k).encode()) % 5), next(k for k in range(50, 99) if zlib.crc32(str(k).encode()) % 5)
    rows = [(ids[0], f"some words {k} of many", "en", "a") for k in range(1000)] + [(ids[1], "all the same", "en", "a")] * 1000 + [(1000 + k, f"words {k} apart", "en", "a") for k in range(1200)]
    drawn = language_id.sampled(documents(spark, rows), "text", "lang", "doc_id", 300).collect()
    times = {"some": 0, "all": 0, "words": 0}
    for r in drawn:
        times[r["text"].split()[0]] += r["times"]
    assert all(70 < n < 140 for n in times.values())


def test_no_segmentation_is_listed_twice():
    """Whole table: all segmentations differ, none is better than one before, and long and short words follow one rule."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() + ["x" * 300, "ab%%%%% ci%%%", "y" * 49 + " " + "y" * 48]
    encoder = piece_codec.Encoder(VOCABULARY)
    flat, counts, scores, others = encoder.encode(texts, 4)
    first = np.cumsum(counts) - counts
    for k in range(len(texts)):
        best = flat[first[k] : first[k] + counts[k]].tolist()
        listed = [best, *(piece_codec.with_edits(best, o["edits"]) for o in others[k])]
        assert len({tuple(x) for x in listed}) == len(listed)
        order = [scores[k], *(o["score"] for o in others[k])]
        assert order == sorted(order, reverse=True)
    words = sorted({w for t in texts if t for w in piece_codec.words_of(t)}, key=len)[-400:]
    for word, number in zip(words, encoder.words.numbers(words), strict=True):
        at = encoder.at.data[number]
        assert n_best(encoder.pieces, word, 4)[0][1] == encoder.ids.data[at : at + encoder.size.data[number]].tolist()


def test_sums_of_long_words():
    pieces = pieces_of(VOCABULARY)
    probs = np.random.default_rng(4).random((pieces.size + 1, 3)) * 1e-3
    words = [SPACE + w for w in ("a", "internationalisierung", "straßenbahn汉字" * 3)]
    x = Lattices(pieces, words)
    sums = x.forward_sums(probs[x.piece])
    for k, w in enumerate(words):
        assert np.allclose(np.log(sums[len(w), :, k]), scaled_sums(pieces, w, probs))
    assert np.isfinite(scaled_sums(pieces, SPACE + "wort" * 5000, probs)).all()


def test_token_ids_are_the_tokenizers():
    """Words set apart, lower-cased and joined anew give the ids that the whole text gives."""
    rng = np.random.default_rng(8)
    marks = list("aB z'.,;!?%#&<|>é\n\t-_ 1²ß´`~İ”…ſ")
    texts = ["".join(rng.choice(marks, 200)) for _ in range(150)] + ["x<|endoftext|> y, don't'. 'll, a's. ok<|startoftext|>. end|> a.<|endoftext|> z", ""]
    encoder = token_store.WordEncoder(token_store.default_tokenizer())
    flat, counts = encoder.encode([t.encode() for t in texts] + [None], 1)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for text, ids in zip([*texts, ""], parts, strict=True):
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
