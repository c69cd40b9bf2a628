"""Collocations: the phrases of each language whose words stand together more than on their own.

Texts, with A-Z in lower case, are cut into pieces at punctuation and line ends, and pieces into words at spaces and tabs. A
phrase of 2 to 4 words with a = f(phrase) >= least is a candidate; cut after its first k words, it has l = f(first part) and
r = f(rest), and the score floor(2000000 * a / (l + r)) of its weakest cut. Candidates inside a longer one with at least
cover per cent of their occurrences are dropped, and each language's first ones by score are returned.

Words that occur least times in their language get numbers in a dictionary; pieces break at all others, as no phrase with
them can be a candidate. Each place becomes a key of four numbers, 16 bytes, zero from where its piece ends. Tasks sort
blocks of keys by radix and send runs of them by ranges of keys, whose bounds come from a sample; a range merges what it is
sent, sorts it by radix and counts runs of equal keys, which lie together for each prefix, so that one sort counts phrases of
two, three and four words. What touches the end of a range is summed with its neighbour. A block or a range is bounded, and
each block sends a key once, however often it occurs. The dictionary is broadcast up to BROADCAST_ROWS words; beyond, the
distinct words of each batch of texts are joined with it and come back to the batch.

Null text counts as empty, null lang as `und`. Rows that repeat count each time; ids are not read. Without texts, or without
candidates, the result is empty. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_batches, running_sums, slices, stored, utf8

LEAST, LONGEST, COVER, TOP, FACTOR = 30, 4, 80, 2000, 2_000_000
#: Counts of words that a task holds before it sums and sends them; keys of a block; keys aimed at in a range; keys between two of the sample.
HELD_WORDS, BLOCK_KEYS, RANGE_KEYS, SAMPLE_KEYS = 400_000, 500_000, 500_000, 512

#: Ends of pieces become line feeds, tabs spaces, A-Z a-z; a full stop is then free to stand for an end.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
END = b"."


def words(texts: list[bytes]) -> list[bytes]:
    """The texts' words, END where a piece ends."""
    return (b"\n".join(texts) + b"\n").translate(_TABLE).replace(b"\n", b" . ").split()


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch (lang, text) for each of its languages."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        yield lang, words(some)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of texts(lang, text), summed by each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[pa.StructArray]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in seen.items():
                whole = pa.Table.from_arrays([pa.chunked_array([p.field(c) for p in parts]) for c in (0, 1)], names=["word", "n"]).group_by("word").aggregate([("n", "sum")])
                for b in whole.filter(pc.not_equal(whole["word"], END)).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(b.num_rows, np.int64))), b["word"].cast(pa.string()), b["n_sum"]], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for b in slices(batch):
                for lang, some in by_language(b):
                    seen.setdefault(lang, []).append(pa.array(some, pa.binary()).value_counts())
                    size += len(seen[lang][-1])
                if size > HELD_WORDS:
                    yield from rows()
                    size = 0
        yield from rows()

    return in_batches(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by uint64 columns, the most significant first: a stable counting sort for each 16 bits in which rows differ."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, each with the sum of its n."""
    order = radix_order([k1, k2])
    k1, k2, n = k1[order], k2[order], n[order]
    new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: len(k1)])
    return k1[new], k2[new], np.add.reduceat(n, new) if len(new) else n


def keys_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, in two halves, of places with two numbers or more before the next zero."""
    x = np.r_[numbers, np.zeros(3, np.int64)].astype(np.uint64)
    a, b, c = x[:-3], x[1:-2], x[2:-1]
    d = np.where(c > 0, x[3:], np.uint64(0))
    at = (a > 0) & (b > 0)
    return (a[at] << np.uint64(32)) | b[at], (c[at] << np.uint64(32)) | d[at]


def big_endian(columns: list[np.ndarray], size: int) -> pa.Array:
    """Binary values of size bytes, of uint64 columns from their high ends on."""
    data = np.stack(columns, axis=1).astype(">u8").view(np.uint8).reshape(len(columns[0]), -1)[:, :size]
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def squeezed(keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """Sorted keys and their counts, compressed: the first halves as differences, which are mostly zero."""
    k1, k2, n = keys
    return [pa.compress(x.astype("<u8").tobytes(), "zstd", asbytes=True) for x in (np.diff(k1, prepend=np.uint64(0)), k2, n)]


def loosened(size: int, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d1, k2, n = (np.frombuffer(pa.decompress(x, 8 * size, "zstd", asbytes=True), "<u8") for x in raw)
    return np.cumsum(d1, dtype=np.uint64), k2, n.astype(np.int64)


BLOCK = "n_keys long, k1 binary, k2 binary, n binary, sample array<binary>"


def blocks(numbered: DataFrame, numbers: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """Rows of BLOCK: sorted distinct keys of a part of the corpus, with their counts."""

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        k1, k2 = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        k1, k2, n = run_lengths(k1, k2, np.ones(len(k1), np.int64))
        some = slice(SAMPLE_KEYS // 2 if len(k1) > SAMPLE_KEYS // 2 else 0, None, SAMPLE_KEYS)
        sample = pa.ListArray.from_arrays(pa.array([0, len(k1[some])], pa.int32()), big_endian([k1[some], k2[some]], 16))
        return pa.RecordBatch.from_arrays([pa.array([len(k1)], pa.int64()), *(pa.array([p], pa.binary()) for p in squeezed((k1, k2, n))), sample], names=["n_keys", "k1", "k2", "n", "sample"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in slices(batch):
                for x in numbers(b):
                    held.append(keys_of(x))
                    size += len(held[-1][0])
                    if size >= BLOCK_KEYS:
                        yield block(held)
                        held, size = [], 0
        if size:
            yield block(held)

    return in_batches(numbered, run, BLOCK)


def with_dictionary(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blocks of texts(lang, text) by a dictionary (lang, word, id) of a size to be broadcast."""
    rows = dictionary.select("lang", "word", "id").orderBy("lang").toArrow()
    langs, word, number = rows["lang"].to_pylist(), rows["word"].combine_chunks().cast(pa.binary()), rows["id"].to_numpy()
    ends = [k for k in range(1, len(langs) + 1) if k == len(langs) or langs[k] != langs[k - 1]]
    # Arrow's strings and a number each: a worker holds no object per word.
    sent = texts.sparkSession.sparkContext.broadcast({langs[a]: (word.slice(a, b - a), np.r_[number[a:b], 0]) for a, b in zip([0, *ends], ends, strict=False)})
    none = pa.array([], pa.binary()), np.zeros(1, np.int64)

    def numbers(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lang, some in by_language(b):
            known, ids = sent.value.get(lang, none)
            coded = pa.array(some, pa.binary()).dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()
            yield ids[at][coded.indices.to_numpy()]

    return blocks(texts, numbers)


def with_joined_words(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blocks of texts(lang, text) by a dictionary (lang, word, id) of any size: batches of texts get the numbers of their own words by a join."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in slices(batch):
                for lang, some in by_language(b):
                    at += 1
                    own = sorted(set(some) - {END})
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([lang], pa.string()), pa.array([b" ".join(some)]), pa.array([[w.decode() for w in own]], pa.list_(pa.string()))], names=["batch", "lang", "text", "words"])

    made = stored(in_batches(texts, batched, "batch long, lang string, text binary, words array<string>"), "phrases-batches")
    found = made.select("batch", "lang", F.explode("words").alias("word")).join(dictionary, ["lang", "word"])
    known = found.groupBy("batch").agg(F.collect_list("word").alias("words"), F.collect_list("id").alias("ids"))

    def numbers(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text, some, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            number = dict(zip((w.encode() for w in some), ids, strict=True))
            split = text.split(b" ")
            yield np.fromiter(map(number.get, split, repeat(0)), np.int64, len(split))

    return blocks(made.select("batch", "text").join(known, "batch").select("text", "words", "ids"), numbers)


def phrase_counts(made: DataFrame, least: int) -> DataFrame:
    """(key, a): the phrases of two to four words that occur least times, as four bytes a word, of stored blocks."""
    total = made.agg(F.sum("n_keys")).first()[0] or 0
    ranges = -(-total // RANGE_KEYS)
    # As many bounds as there are ranges: what the smallest of the sample in each is.
    sampled = made.select(F.explode("sample").alias("key")).repartitionByRange(max(1, ranges), "key")
    lowest = sampled.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).collect()
    bounds = np.frombuffer(b"".join(sorted(bytes(r["key"]) for r in lowest)[1:]), ">u8").reshape(-1, 2).astype(np.uint64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k1, k2, n = loosened(size, raw)
                low, high = np.searchsorted(k1, bounds[:, 0], "left"), np.searchsorted(k1, bounds[:, 0], "right")
                cuts = [0, *(a + int(np.searchsorted(k2[a:b], x, "left")) for a, b, x in zip(low.tolist(), high.tolist(), bounds[:, 1], strict=True)), len(k1)]
                for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < b:
                        columns = [pa.array([r], pa.int64()), pa.array([b - a], pa.int64()), *(pa.array([c], pa.binary()) for c in squeezed((k1[a:b], k2[a:b], n[a:b])))]
                        yield pa.RecordBatch.from_arrays(columns, names=["range", "n_keys", "k1", "k2", "n"])

    def counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k1, k2, n = run_lengths(*(np.concatenate([p[c] for p in parts]) for c in range(3)))
        third = k2 >> np.uint64(32)
        prefixes = [(k1, None, np.ones(len(k1), bool)), (k1, third, third > 0), (k1, k2, (k2 & np.uint64(0xFFFFFFFF)) > 0)]
        for size, (x, y, whole) in enumerate(prefixes, 2):
            new = np.r_[True, x[1:] != x[:-1]] if y is None else np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            at = np.flatnonzero(new)
            sums = np.add.reduceat(n, at)
            keep = sums >= least
            keep[[0, -1]] = True  # these may go on in the next range
            keep &= whole[at]
            if keep.any():
                yield pa.RecordBatch.from_arrays([big_endian([k1[at[keep]], (k2[at[keep]] if size > 2 else k1[at[keep]])], 4 * size), pa.array(sums[keep])], names=["key", "a"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for r, size, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at and held:
                    yield from counted(held)
                    held = []
                at = r
                held.append(loosened(size, raw))
        if held:
            yield from counted(held)

    parts = in_batches(made.select("n_keys", "k1", "k2", "n"), split, "range long, n_keys long, k1 binary, k2 binary, n binary")
    runs = in_batches(parts.repartition("range").sortWithinPartitions("range"), merged, "key binary, a long")
    return runs.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def bounded(df: DataFrame) -> DataFrame:
    """df (stored), to be broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language) and score of each language's first top phrases."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stored(word_counts(texts), "phrases-words")
    totals = bounded(stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals"))
    frequent = counts.filter(F.col("n") >= least).withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    dictionary = running_sums(stored(frequent, "phrases-frequent"), "all", ["lang", "word"], "one", "phrases-numbers")
    number = F.col("before") + 1  # 0 is the end of a piece
    dictionary = stored(dictionary.select("lang", "word", F.col("n").alias("f"), number.alias("id"), F.unhex(F.lpad(F.hex(number), 8, "0")).alias("key")), "phrases-dictionary")
    small = dictionary.count()
    if small >= 1 << 32:
        raise ValueError("a dictionary has 4294967295 words at most")
    made = stored((with_dictionary if small <= BROADCAST_ROWS else with_joined_words)(texts, dictionary), "phrases-blocks")
    phrases = stored(phrase_counts(made, least), "phrases-counts")
    size = F.length("key") / 4
    # Cuts: both sides of a candidate's cuts occur as often as the candidate at least, so they are words or candidates themselves.
    known = stored(phrases.unionByName(dictionary.select("key", F.col("f").alias("a"))), "phrases-known")
    first = bounded(known.select(F.col("key").alias("first"), F.col("a").alias("l")))
    rest = bounded(known.select(F.col("key").alias("rest"), F.col("a").alias("r")))
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), size.cast("int") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr("substring(key, 1, 4 * k)").alias("first"), F.expr("substring(key, 4 * k + 1)").alias("rest"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(first, "first").join(rest, "rest").withColumn("_num", exact("a") * FACTOR).withColumn("_den", exact("l") + exact("r")).withColumn("score", F.expr("_num div _den"))
    weakest = scored.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("key", "a", "cut.l", "cut.r", "cut.score")
    inner = phrases.filter(size > 2).select(F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, cast(length(key) / 4 as int) - 1), m -> transform(sequence(0, cast(length(key) / 4 as int) - m), i -> substring(key, 4 * i + 1, 4 * m))))")).alias("key"))
    inside = bounded(stored(inner.groupBy("key").agg(F.max("longer").alias("longer")), "phrases-inside"))
    kept = weakest.join(inside, "key", "left").filter(F.coalesce(exact("longer") * 100 < exact("a") * cover, F.lit(True))).drop("longer")
    named = kept
    for k in range(LONGEST):
        # A phrase of fewer words has an empty key there; spread, so that no task gets them all where the join is shuffled.
        own = bounded(dictionary.select(F.col("key").alias(f"_key{k}"), F.col("word").alias(f"_word{k}"), *([F.col("lang")] if k == 0 else [])))
        part = F.expr(f"substring(key, {4 * k + 1}, 4)")
        named = named.withColumn(f"_part{k}", F.when(F.length(part) > 0, part).otherwise(F.col("key"))).join(own, F.col(f"_part{k}") == F.col(f"_key{k}"), "left").drop(f"_part{k}", f"_key{k}")
    named = named.withColumn("phrase", F.concat_ws(" ", *(f"_word{k}" for k in range(LONGEST))))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within shares of a language, so that the last window gets top rows of each share at most.
    near = named.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS r, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, w[s:s + m - 1] AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS m), unnest(range(1, len(w) - m + 2)) AS t(s)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1),
cut AS (SELECT c.lang, c.g, c.m, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
        FROM c, unnest(range(1, c.m)) AS t(k) JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:c.m]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS i FROM cut) WHERE i = 1),
inside AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, g[s:s + n - 1] AS sub FROM c, (SELECT unnest([2, 3]) AS n), unnest(range(1, m - n + 2)) AS t(s) WHERE n < m) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.sub = best.g WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN t USING (lang) WHERE rank <= 2000
"""
