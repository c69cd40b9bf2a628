"""Decontamination: what of the documents stands in the items of a benchmark.

Words are runs of letters, digits and anything beyond ASCII, with A-Z in lower case. An item's windows are its runs of WINDOW
words; an item of fewer words, but not none, is one window. A document's word is hit if it lies in an occurrence of a window.

The whole path is DataFrame functions. An occurrence of a window of n words covers a place that is a multiple of the stride s,
and from there n - s + 1 of the window's words: its seed. So documents are scanned at every s-th word only. Seeds are looked up
by their hash in the broadcast hash set of the items' seeds, and each that is found brings the words around it, in which the
windows are then verified word by word. Beyond SEED_ROWS the set is not broadcast and the lookup is a shuffled join.

Hits are summed up by text (128 bits of hash), so that copies of a text, however many, are one group, whose size one text bounds.

Null and empty texts, and those without words, have no words and no hits; items of that kind have no windows. Rows that repeat
a doc_id, or have none, are judged each on its own. Items that repeat an item_id are one item; items without item_id hit
words, but are neither counted nor listed. Without documents the result is empty, without items nothing is hit. Further
columns are ignored (or kept, in what removes rows or spans). One text must fit in a task's memory, with its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

WINDOW = 10
#: Seeds (a hash and a length each) up to which the set is broadcast.
SEED_ROWS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no word, before and after A-Z become a-z.
BETWEEN_RAW, BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def stride(n: int) -> int:
    """Every so many words a document is looked at for windows of n words."""
    return max(1, n // 2 - 1)


def words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{BETWEEN}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("f1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("f2")]


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(n, window, items): each distinct window, its number of words, and the ids of its items as sorted strings."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    split = split.withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = split.select("item", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("window"))
    return each.groupBy("n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def looks(n: int) -> str:
    """SQL for the places of w that are looked at for windows of n words: the seed's hash, and up to n + s - 1 words around it."""
    s = stride(n)
    g = n - s + 1
    # Around the seed at p (from 0): words from p - (s - 1) on, to p + n - 1.
    one = f"named_struct('n', {n}, 'at', greatest(0, j * {s} - {s - 1}), 'seed', xxhash64({n}, slice(w, j * {s} + 1, {g})), 'near', array_join(slice(w, greatest(0, j * {s} - {s - 1}) + 1, j * {s} + {n} - greatest(0, j * {s} - {s - 1})), ' '))"
    return f"if(size(w) >= {n}, transform(sequence(0, (size(w) - {g}) div {s}), j -> {one}), array())"


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, f1, f2, n_words), one per row of docs, and rows (f1, f2, n, at, items): a window of n words begins at word at."""
    windows = stored(item_windows(items, item_col, item_text_col, window), "leak-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # window of them at most
    seeds = None
    for n in lengths:
        s = stride(n)
        own = windows.filter(F.col("n") == n).select(F.explode(F.expr(f"transform(sequence(1, {s}), o -> xxhash64({n}, slice(split(window, ' '), o, {n - s + 1})))")).alias("_seed"))
        seeds = own if seeds is None else seeds.unionByName(own)
    split = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)), words(F.col(text_col)).alias("w"))
    split = split.withColumn("n_words", F.size("w").cast("long"))
    if seeds is None:
        counted = split.select("doc_id", "f1", "f2", "n_words")
        return counted, counted.selectExpr("f1", "f2", "1 as n", "0 as at", "array('') as items").limit(0)
    seeds = stored(seeds.distinct(), "leak-seeds")
    seeds = F.broadcast(seeds) if seeds.count() <= SEED_ROWS else seeds
    # The first of a document's rows speaks for the document, whether or not anything is found.
    head = "array(named_struct('n', 0, 'at', 0, 'seed', cast(null as bigint), 'near', cast(null as string)))"
    each = split.select("doc_id", "f1", "f2", "n_words", F.explode(F.expr(f"concat({', '.join([head, *map(looks, lengths)])})")).alias("x")).select("doc_id", "f1", "f2", "n_words", "x.*")
    # Rows without seed are spread, so that no task gets them all where the join is shuffled.
    found = each.join(seeds, F.coalesce("seed", F.xxhash64("f1", "f2", "doc_id", "n_words")) == F.col("_seed"), "left").filter("n = 0 or _seed is not null").drop("_seed", "seed")
    found = stored(found, "leak-marks")
    counted = found.filter("n = 0").select("doc_id", "f1", "f2", "n_words")
    around = found.filter("n > 0").select("f1", "f2", "n", "at", F.split("near", " ").alias("w"))
    tried = around.filter("size(w) >= n").select("f1", "f2", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> named_struct('at', at + i, 'window', array_join(slice(w, i + 1, n), ' ')))")).alias("x")).select("f1", "f2", "n", "x.at", "x.window")
    sure = F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows
    return counted, tried.join(sure, ["n", "window"]).select("f1", "f2", "n", "at", "items")


#: Spans [begin, end) of words in order, those that touch made one: from the places and lengths of windows.
MERGED = """aggregate(array_sort(places), cast(array() as array<struct<begin: bigint, end: bigint>>), (done, x) ->
  if(size(done) > 0 and element_at(done, -1).end >= x.at,
     concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.at + x.n)))),
     concat(done, array(named_struct('begin', x.at, 'end', x.at + x.n)))))"""


def hit_spans(hits: DataFrame) -> DataFrame:
    """(f1, f2, places, n_hit) of texts with hits: where their windows begin, and how many words these cover."""
    places = hits.groupBy("f1", "f2").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))).alias("places"))
    cover = "aggregate(array_sort(places), named_struct('upto', 0L, 'hit', 0L), (a, x) -> named_struct('upto', greatest(a.upto, x.at + x.n), 'hit', a.hit + greatest(0L, x.at + x.n - greatest(a.upto, x.at))), a -> a.hit)"
    return places.select("f1", "f2", "places", F.expr(cover).alias("n_hit"))


def hit_items(hits: DataFrame) -> DataFrame:
    """(f1, f2, ids): the ids of the items with windows in a text, as sorted strings."""
    # Windows of one passage have the same items: these lists are made distinct before they are opened.
    lists = hits.select("f1", "f2", "items").distinct()
    each = lists.select("f1", "f2", F.explode("items").alias("item")).distinct()
    return each.groupBy("f1", "f2").agg(F.array_sort(F.collect_list("item")).alias("ids"))


def by_text(rows: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """rows joined with texts (stored) on f1 and f2."""
    return rows.join(F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts, ["f1", "f2"], how)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    counted, hits = occurrences(docs, items, window=window, **columns)
    hits = stored(hits, "leak-hits")
    texts = hit_spans(hits).drop("places").join(hit_items(hits), ["f1", "f2"], "left")
    found = by_text(counted, stored(texts, "leak-texts"), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _with_spans(docs: DataFrame, items: DataFrame, how: str, window: int, text_col: str, **columns: str) -> DataFrame:
    """docs and _leak_spans; what it adds has names of its own, whatever the columns of docs are called."""
    spans = hit_spans(occurrences(docs, items, window=window, text_col=text_col, **columns)[1])
    spans = stored(spans.select(F.col("f1").alias("_leak_f1"), F.col("f2").alias("_leak_f2"), F.expr(MERGED).alias("_leak_spans")), "leak-spans")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    f1, f2 = text_key(F.col(text_col))
    keyed = docs.withColumn("_leak_1", f1).withColumn("_leak_2", f2)
    return keyed.join(spans, (F.col("_leak_1") == F.col("_leak_f1")) & (F.col("_leak_2") == F.col("_leak_f2")), how)


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of docs without a hit, as they are."""
    return _with_spans(docs, items, "left_anti", window, text_col, **columns).select(*docs.columns)


def cleaned_texts(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", **columns: str) -> DataFrame:
    """docs with the words that are hit cut out of the texts, each with what follows it up to the next word."""
    marked = _with_spans(docs, items, "left", window, text_col, **columns)
    head = F.regexp_extract(text_col, f"^[{BETWEEN_RAW}]*", 0)
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(f"[^{BETWEEN_RAW}]+[{BETWEEN_RAW}]*"), F.lit(0))
    marked = marked.withColumn("_leak_tokens", F.when(F.col("_leak_spans").isNotNull(), tokens))
    kept = F.expr("array_join(filter(_leak_tokens, (t, i) -> not exists(_leak_spans, s -> i >= s.begin and i < s.end)), '')")
    text = F.when(F.col("_leak_spans").isNull(), F.col(text_col)).otherwise(F.concat(head, kept))
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS win FROM i, unnest(range(1, len(w) - n + 2)) AS t(s)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, n, s, w[s:s + n - 1] AS win FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(s)),
hit AS (SELECT r, s, n, item_id FROM dwin JOIN win USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
