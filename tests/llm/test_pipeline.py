import corpus_pipeline
from pulseforge.llm import piece_codec
from pulseforge.llm.language_id import default_vocabulary
from pulseforge.llm.lattice import SPACE, pieces_of

from .shared import AWKWARD, documents
from .test_dedup_mix_quality import same_text
from .test_ngram_join import expected, near_copies


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages(spark):
    """Each stage on what its predecessor kept, against plain definitions."""
    words = {"en": "the house and garden were there with them ", "de": "und das schöne Haus steht über der Straße "}
    rows = [*AWKWARD, *near_copies(3, groups=2, copies=10)[len(AWKWARD) :]]
    rows += [(7000 + k, words[lang] * 3 + f"number{k} {k}", lang, f"s{k % 4}") for k, lang in enumerate(["en", "de"] * 15)]
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    spoken = stages["language_id"](spark, docs, "").cache()
    assert spoken.columns == corpus_pipeline.COLUMNS
    held = as_rows(spoken)
    assert all(any(c.isalpha() for c in t or "") for _, t, _, _ in held) and {r[0] for r in rows if r[0] is not None and r[0] >= 7000} <= {r[0] for r in held}
    once = stages["exact_dedup"](spark, spoken, "").cache()
    groups = same_text(held)
    assert sorted(str(r[0]) for r in as_rows(once)) == sorted(str(min((i for i in ids if i is not None), default=None)) for ids in groups.values())
    apart = stages["ngram_jaccard_join"](spark, once, "").cache()
    want = [d for d, _, c in expected(as_rows(once), 5, 8, 10) if d == c]
    assert sorted(-1 if r[0] is None else r[0] for r in as_rows(apart)) == want
    mixed = stages["source_mixing"](spark, apart, "").cache()
    assert mixed.columns == corpus_pipeline.COLUMNS
    size = {r[0]: len(r[1].encode().split()) for r in as_rows(apart)}
    taken = {}
    for d, t, _, _ in as_rows(mixed):
        taken[d] = taken.get(d, 0) + len(t.encode().split())
    assert all(n <= 2 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values()) + 200
    pieces = pieces_of(default_vocabulary())
    texts = sorted(t.replace(SPACE, " ") for _, t, _, _ in as_rows(mixed))
    assert sorted(piece_codec.decoded(pieces, r["ids"]) for r in stages["sentencepiece"](spark, mixed, "").collect()) == texts


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100 and all(r["ids"] for r in rows)


def test_stages_of_an_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
