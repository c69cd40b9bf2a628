"""Quality rules by repetition coverage.

Words are runs of other than ASCII white space. Rolling hashes of their hashes, for several n-gram lengths, find n-grams
that occur earlier in the same text; the characters (code points) of the words inside such repeats, and of repeated lines,
are held against shares of the text. Hashes have 64 bits and are mixed with the row's place in its batch, so that all the
texts of a step are sorted at once. An n-gram can only repeat where its first n - 1 words do, so each length looks only at
the places that the one before it left.

Null and empty texts have no words and fail the base rule. Rows that repeat a doc_id are judged each on its own; further
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import Growing, Interned, map_arrow, mix64, utf8

SYMBOLS = b"#*$%&|<>"
#: Most per cent of a text's word characters that may lie in repeated n-grams, by n (the bounds of the Gopher rules).
NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most per cent of the lines with a word, and of their characters, that may repeat earlier lines.
LINE_PERCENT, LINE_CHARS_PERCENT = 30, 20

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_PERCENT)]
SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in COLUMNS)}, base_failed boolean, kept boolean"

_base = np.uint64(0x9E3779B97F4A7C15 | 1)
_hashes, _chars = Growing(np.uint64), Growing(np.int64)


def _fill(words: list[bytes]) -> None:
    _hashes.extend(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
    _chars.extend(np.array([len(w.decode("utf-8", "replace")) for w in words], np.int64))


def _clear() -> None:
    _hashes.clear()
    _chars.clear()


_words = Interned(_fill, _clear)


def repeated_lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, their characters, and both of those that equal an earlier line."""
    lines, seen = 0, {}
    chars = repeats = repeat_chars = 0
    for line in text.split(b"\n"):
        if not line or line.isspace() and not line.split():
            continue
        lines += 1
        if line in seen:
            n = seen[line]
            repeats += 1
            repeat_chars += n
        else:
            n = seen[line] = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
        chars += n
    return lines, chars, repeats, repeat_chars


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of n that begins in starts."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, size), -1)
    return np.cumsum(edge[:size]) > 0


def repetition(texts: list[bytes | None]) -> np.ndarray:
    """A row of COLUMNS for each text."""
    out = np.zeros((len(texts), len(COLUMNS)), np.int64)
    words: list[bytes] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        own = text.split()
        words += own
        out[k, 0] = len(own)
        out[k, 2] = sum(text.count(bytes([c])) for c in SYMBOLS)
        out[k, 5], out[k, 6], out[k, 3], out[k, 7] = repeated_lines(text)
    number = _words.numbers(words)
    if not len(number):
        return out
    doc = np.repeat(np.arange(len(texts)), out[:, 0])
    ends = np.repeat(np.cumsum(out[:, 0]), out[:, 0])
    chars, h = _chars.data[number], mix64(_hashes.data[number])
    size = len(h)
    total = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    out[:, 1] = total(chars)
    salt = mix64(doc.astype(np.uint64) + np.uint64(1))
    roll = h.copy()
    at = np.arange(size)  # the places that may still begin a repeat
    for n in range(2, max(NGRAM_PERCENT) + 1):
        at = at[at + n <= ends[at]]
        roll = roll[: size - n + 1] * _base + h[n - 1 :]
        if n == 2:
            continue
        key = mix64(roll[at] ^ salt[at])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again, any_of = np.zeros(len(at), bool), np.zeros(len(at), bool)
        again[order[1:]] = same
        any_of[order[1:]] |= same
        any_of[order[:-1]] |= same
        if n == 3:
            out[:, 4] = total(covered(at[any_of], n, size))
        if n in NGRAM_PERCENT:
            out[:, 8 + list(NGRAM_PERCENT).index(n)] = total(np.where(covered(at[again], n, size), chars, 0))
        at = at[any_of]
        if not len(at):
            break
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts, base_failed (fewer than 50 words, or more than half of them in repeated 3-word windows) and kept."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        x = repetition(utf8(b.column(1)))
        failed = (x[:, 0] < 50) | (100 * x[:, 4] > 50 * x[:, 0])
        bad = (100 * x[:, 3] > LINE_PERCENT * x[:, 5]) | (100 * x[:, 7] > LINE_CHARS_PERCENT * x[:, 6])
        for k, most in enumerate(NGRAM_PERCENT.values()):
            bad |= 100 * x[:, 8 + k] > most * x[:, 1]
        columns = [b.column(0), *(pa.array(c) for c in x.T), pa.array(failed), pa.array(~failed & ~bad)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *COLUMNS, "base_failed", "kept"])

    return map_arrow(docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text"), step, SCHEMA)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT r, i, u AS line FROM (SELECT r, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
      WHERE regexp_matches(u, '[^\x20\x09-\x0D]')),
ln AS (SELECT r, count(*) AS n_lines, sum(length(line)) AS line_chars, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1), 0) AS dup_line_chars
       FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l) GROUP BY r),
g AS (SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS g FROM w, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n), unnest(range(1, len(words) - n + 2)) AS s(i)),
k AS (SELECT r, n, i, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS k, count(*) OVER (PARTITION BY r, n, g) AS c FROM g),
p AS (SELECT DISTINCT r, n, p FROM (SELECT r, n, unnest(range(i, i + n)) AS p FROM k WHERE (n = 3 AND c > 1) OR (n > 3 AND k > 1))),
s AS (SELECT p.r, p.n, count(*) AS covered, sum(length(w.words[p.p])) AS chars FROM p JOIN w USING (r) GROUP BY p.r, p.n),
m AS (SELECT r, max(covered) FILTER (n = 3) AS n_repeat_words, %s FROM s GROUP BY r),
a AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0)::BIGINT AS line_chars,
             coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, %s
      FROM w LEFT JOIN ln USING (r) LEFT JOIN m USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT (100 * n_dup_lines > %d * n_lines OR 100 * dup_line_chars > %d * line_chars OR %s) AS kept FROM b
""" % (
    ", ".join(f"max(chars) FILTER (n = {n}) AS c{n}" for n in NGRAM_PERCENT),
    ", ".join(f"coalesce(c{n}, 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_PERCENT),
    LINE_PERCENT,
    LINE_CHARS_PERCENT,
    " OR ".join(f"100 * dup_chars_{n} > {p} * word_chars" for n, p in NGRAM_PERCENT.items()),
)
