"""Documents that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

AWKWARD = [
    (1, "the cat sat on the mat\nthe cat sat on the mat\n", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "word " * 30000, "en", "b"),
    (5, "the cat  sat\ton the mat the cat sat on the mat ", "en", "a"),
    (6, "der Hund läuft schnell über die Straße und bellt laut", "de", None),
    (7, "x" * 5000, "de", "c"),
    (8, "你好 wörld 𝔘 <|im_end|> ▁ end\n\n\tfoo", "zz", "c"),
    (8, "你好 wörld 𝔘 <|im_end|> ▁ end\n\n\tfoo", "zz", "c"),
    (9, " \n\t ", "en", "a"),
    (None, "no id here at all, but some words", "en", "b"),
    (10, "12345 $$$ !!!", "en", "a"),
]


def documents(spark, rows=AWKWARD, parts=3):
    """With columns that clash with names used inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, part int, rank string, size string"
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "x", "y") for r in rows], schema).repartition(parts)


def empty(spark):
    return documents(spark).limit(0)
