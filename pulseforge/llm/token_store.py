"""Token ids in a content-addressed store.

Texts become ids, and a rolling hash over the last ids cuts each document's stream into chunks, so that equal passages give
equal chunks. A chunk's name is its digest; each is stored once. The recipe of a document names its chunks in order, with
their lengths and the root of a Merkle tree over them; recipes lie in ascending order of doc_id (null first), and a manifest
has for each range of them the number of documents and ids, the ids before it, and the root over its documents' roots.

Tables of a store, each a Parquet folder: chunks(digest, n, data: little-endian ids of `width` bytes), recipes(part, pos,
doc_id, n_tokens, names, sizes, root), manifest(part, docs, tokens, first, root). Reading back checks digests and
roots and never brings a document's ids together: the checksums of its chunks combine.

Null text counts as empty: such a document has the end id alone. Rows that repeat a doc_id are documents of their own, in
the order of their roots. An empty table makes an empty store. Whole texts are encoded word by word (words between places at
which the vocabulary's own rules cut too: ASCII white space, and before marks that end a word), each distinct word once.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Growing, Interned, in_batches, map_arrow, mix64, running_sums, shared_folder, slices, stored, utf8

END_ID = 1
#: Bytes of text that are encoded in one step: the more, the fewer words are looked up twice.
ENCODE_BYTES = 4 << 20
#: Ids that the rolling hash looks at, fewest and most ids of a chunk, and the chance of a cut.
WINDOW, LEAST, MOST, CUT_BITS = 16, 64, 2048, 8
DIGEST = 16

_odd = 0xD1342543DE82EF95
_inverse = pow(_odd, -1, 1 << 64)
_gear = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that the tokenizer gets as one text.
TEXT_WORDS = 200


def plain_letters(word: str) -> bool:
    """Whether the tokenizer's rules take word as one word for certain: Latin letters, in lower case too."""
    return word.isascii() and word.isalpha() or max(word) < "\u0250" and word.isalpha() and word.lower().isalpha()


#: The rule of words under which bare_of holds
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def bare_of_rules(rules: dict) -> bool:
    """Whether a tokenizer's rules leave words of letters a-z as they are."""
    first, second = ((rules.get(name) or {}).get(f"{kind}s", []) for name, kind in (("normalizer", "normalizer"), ("pre_tokenizer", "pretokenizer")))
    if [x["type"] for x in first] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in second] != ["Split", "ByteLevel"]:
        return False
    return first[1]["pattern"] == {"Regex": r"\s+"} and second[0]["pattern"] == {"Regex": WORD_RULE} and not second[1]["add_prefix_space"]


def bare_of(file: str):
    """The tokenizer of a file without its rules: its model alone. None if they are not such that words of letters a-z need none."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    with open(file, encoding="utf-8") as f:
        if not bare_of_rules(json.load(f)):
            return None
    bare = Tokenizer.from_file(file)
    bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
    return bare


#: 1: a letter a-z, 2: a character whose runs the tokenizer's rules take as one word, 4: white space; apostrophes are of none, nor
#: the characters of the vocabulary's special tokens.
_kinds = np.zeros(256, np.uint8)
_kinds[97:123] = 1
_kinds[[*b'!"#$%&()*+,-./:;=?@[]^_`{}~']] = 2
_kinds[[*b" \t\n\v\f\r"]] = 4


def spaced_out(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with other ids for none, and where each text ends: A-Z in lower case, white space after each, and a space before a
    run of marks between a letter and white space, where the tokenizer cuts anyway. So far fewer words are different."""
    joined = np.frombuffer(b"".join((t or b"") + b"\n" for t in texts).lower(), np.uint8)
    kind = _kinds[joined]
    begin = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    others = np.flatnonzero(kind != 2)
    begin = begin[kind[others[np.searchsorted(others, begin)]] == 4]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.insert(joined, begin, 32), ends + np.searchsorted(begin, ends)


def words_of(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts, in order, and how many each text has; no object is made of a word."""
    spaced, ends = spaced_out(texts)
    inside = np.concatenate([[False], _kinds[spaced] != 4, [False]])
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(spaced[inside[1:-1]])])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


class WordEncoder:
    """Ids of words by the tokenizers library."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.bare = bare_of(file) or self.tokenizer
        self.at, self.size, self.ids = Growing(np.int64), Growing(np.int64), Growing(np.uint32)
        self.words = Interned(self.fill, lambda: [x.clear() for x in (self.at, self.size, self.ids)])

    def fill(self, words: list[bytes]) -> None:
        """Words go to the tokenizer as texts of many words. A word of plain letters is one word to the tokenizer too, which numbers
        them, and one of letters a-z needs none of its rules; of the other words, where an id comes from tells whose it is."""
        for a in range(0, len(words), 20_000):
            plain = [w.decode("utf-8", "replace") for w in words[a : a + 20_000]]
            kind = np.fromiter((0 if w.isascii() and w.isalpha() and w.islower() else 1 if plain_letters(w) else 2 for w in plain), np.int8, len(plain))
            kinds = [(np.flatnonzero(kind == k), *how) for k, how in enumerate([(self.bare, self.numbered), (self.tokenizer, self.numbered), (self.tokenizer, self.located)])]
            order, sizes = np.concatenate([rows for rows, *_ in kinds]), np.zeros(len(plain), np.int64)
            flat: list[np.ndarray] = []
            for rows, tokenizer, owners in kinds:
                for at in range(0, len(rows), TEXT_WORDS):
                    part = rows[at : at + TEXT_WORDS]
                    flat.append(np.array(self.tokens(tokenizer, owners, [plain[k] for k in part], part, sizes), np.uint32))
            ends = self.ids.n + np.cumsum(sizes[order])
            places = np.empty(len(plain), np.int64)
            places[order] = ends - sizes[order]
            self.at.extend(places)
            self.size.extend(sizes)
            self.ids.extend(np.concatenate(flat))

    @staticmethod
    def tokens(tokenizer, owners, words: list[str], rows: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The ids of words; sizes[rows] becomes how many each has."""
        made = tokenizer.encode(" ".join(words), add_special_tokens=False)
        sizes[rows] = np.bincount(owners(made, words), minlength=len(words))
        return made.ids

    @staticmethod
    def numbered(made, words: list[str]) -> np.ndarray:
        return np.array(made.word_ids, np.int64)

    @staticmethod
    def located(made, words: list[str]) -> np.ndarray:
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        return np.searchsorted(starts, np.array(made.offsets, np.int64).reshape(-1, 2)[:, 0], side="right") - 1

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with end_id after each text, and how many each text has."""
        found, sizes = words_of(texts)
        words = self.words.numbers(found)
        lengths, at = self.size.data[words], self.at.data[words]
        doc = np.repeat(np.arange(len(texts)), sizes)
        counts = np.bincount(doc, weights=lengths, minlength=len(texts)).astype(np.int64) + 1
        ends = np.cumsum(lengths)
        flat = np.empty(int(counts.sum()), np.uint32)
        last = np.cumsum(counts) - 1
        inner = np.ones(len(flat), bool)
        inner[last] = False
        flat[last] = end_id
        flat[inner] = self.ids.data[np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, counts


_encoders: dict[str, WordEncoder] = {}


def _encoder(file: str) -> WordEncoder:
    if file not in _encoders:
        _encoders.clear()
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def cuts(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, counted from its first id."""
    n = len(flat)
    power = np.full(n, _odd, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n, _inverse, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.cumsum(_gear[flat & 0xFFFF] * inverse, dtype=np.uint64)
    rolling = sums.copy()
    rolling[WINDOW:] -= sums[:-WINDOW]
    marks = np.flatnonzero(mix64(rolling * power) >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, start = [], 0
    for count in counts.tolist():
        own = marks[np.searchsorted(marks, start + 1) : np.searchsorted(marks, start + count)] - start
        ends, last = [], 0
        for mark in [*own.tolist(), count]:
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST or mark == count and mark > last:
                ends.append(mark)
                last = mark
        out.append(ends)
        start += count
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves; a lone last node moves up as it is. No leaves: the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [hashlib.blake2b(digest_size=DIGEST).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split_names(names: bytes) -> list[bytes]:
    return [names[i : i + DIGEST] for i in range(0, len(names), DIGEST)]


_RECORD = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()), ("root", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("data", pa.binary()), ("task", pa.int64())])
_RECORD_DDL = "kind string, doc_id long, n_tokens long, names binary, sizes binary, root binary, digest binary, n long, data binary, task long"


class Store:
    def __init__(self, spark: SparkSession, path: str, width: int):
        self.path, self.width = path, width
        self.chunks = spark.read.schema("digest binary, n long, data binary").parquet(f"{path}/chunks")
        self.recipes = spark.read.schema("doc_id long, n_tokens long, names binary, sizes binary, root binary, part int, pos long").parquet(f"{path}/recipes")
        self.manifest = spark.read.schema("part int, docs long, tokens long, first long, root binary").parquet(f"{path}/manifest")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, width: int = 2, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> Store:
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, known = TaskContext.get().partitionId(), set()
        for batch in batches:
            for b in slices(batch, ENCODE_BYTES):
                flat, counts = _encoder(tokenizer).encode(utf8(b.column(1)), end_id)
                if int(flat.max(initial=0)) >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit {width} bytes")
                raw = flat.astype(kind).tobytes()
                recipes, chunks, start = [], [], 0
                for doc_id, count, ends in zip(b.column(0).to_pylist(), counts.tolist(), cuts(flat, counts), strict=True):
                    names, last = [], 0
                    for end in ends:
                        data = raw[(start + last) * width : (start + end) * width]
                        names.append(digest := hashlib.blake2b(data, digest_size=DIGEST).digest())
                        if digest not in known:
                            known.add(digest)
                            chunks.append((digest, end - last, data))
                        last = end
                    recipes.append((doc_id, count, b"".join(names), np.diff(ends, prepend=0).astype("<i4").tobytes(), merkle(names)))
                    start += count
                nothing, zero = [None] * len(chunks), [None] * len(recipes)
                rows = [["recipe"] * len(zero) + ["chunk"] * len(nothing)]
                rows += [[r[i] for r in recipes] + nothing for i in range(5)] + [zero + [c[i] for c in chunks] for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*rows, [task] * len(rows[0])], _RECORD, strict=True)], schema=_RECORD)

    made = f"{path}/parts"
    in_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, _RECORD_DDL).write.partitionBy("kind").parquet(made)
    both = spark.read.schema(_RECORD_DDL.replace("kind string, ", "") + ", kind string").parquet(made)
    chunks = both.filter("kind = 'chunk'").select("digest", "n", "data", "task")
    # A chunk that several tasks met is kept from the first of them.
    extra = chunks.groupBy("digest").agg(F.min("task").alias("first"), F.count("*").alias("k")).filter("k > 1").select("digest", "first")
    extra = stored(extra, "store-shared-chunks")
    extra = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
    chunks.join(extra, "digest", "left").filter("first is null or first = task").select("digest", "n", "data").write.parquet(f"{path}/chunks")
    recipes = both.filter("kind = 'recipe'").select("doc_id", "n_tokens", "names", "sizes", "root").withColumn("stream", F.lit(0))
    running_sums(recipes, "stream", ["doc_id", "root"], "n_tokens", "store-recipes").drop("stream", "before").write.parquet(f"{path}/recipes")
    drop(spark, made)
    ordered = spark.read.schema("root binary, part int, pos long, n_tokens long").parquet(f"{path}/recipes")

    def range_root(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        return pd.DataFrame({"part": frame["part"].iloc[:1], "docs": len(frame), "tokens": int(frame["n_tokens"].sum()), "root": [merkle(list(frame["root"]))]})

    ranges = ordered.groupBy("part").applyInPandas(range_root, "part int, docs long, tokens long, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")
    return Store(spark, path, width)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= b * ((a >> np.uint64(bit)) & np.uint64(1))
        b = (b >> np.uint64(1)) ^ (_POLY * (b & np.uint64(1)))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a piece with this CRC-32 adds to the whole's, when after bytes follow it; the whole's is the exclusive or of all."""
    out, power, left = crc.astype(np.uint64), np.array([1 << 23], np.uint64), after.astype(np.int64).copy()
    while left.any():
        out = np.where(left & 1, _times(np.broadcast_to(power, out.shape), out), out)
        power, left = _times(power, power), left >> 1
    return out


def read_back(store: Store) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers), n_chunks, verified."""
    kind, width = {2: "<u2", 4: "<u4"}[store.width], store.width

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        crc, good = [], []
        for digest, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            crc.append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
            good.append(len(data) == n * width and hashlib.blake2b(data, digest_size=DIGEST).digest() == digest)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64()), pa.array(good)], names=["digest", "n", "crc", "good"])

    def unfold(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = dict(zip(b.schema.names, (c.to_pylist() for c in b.columns), strict=True))
        sizes = [np.frombuffer(s, "<i4").astype(np.int64) for s in cols["sizes"]]
        names = [split_names(x) for x in cols["names"]]
        roots = [merkle(x) == r and int(s.sum()) == t for x, r, s, t in zip(names, cols["root"], sizes, cols["n_tokens"], strict=True)]
        reps = np.array([len(x) for x in names])
        after = [4 * (s.sum() - np.cumsum(s)) for s in sizes]
        fixed = [pa.array(cols[c], b.schema.field(c).type).take(pa.array(np.repeat(np.arange(len(reps)), reps))) for c in ("part", "pos", "doc_id", "start")]
        return pa.RecordBatch.from_arrays([*fixed, pa.array([d for x in names for d in x], pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(after)), pa.array(np.repeat(np.array(roots, bool), reps))], names=["part", "pos", "doc_id", "start", "digest", "size", "after", "root_good"])

    @F.pandas_udf("long")
    def placed(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shifted(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    checked = map_arrow(store.chunks, check, "digest binary, n long, crc long, good boolean")
    # start is the ids before a range (from the manifest, one row per range) and those before the row in it.
    inner = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    recipes = store.recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(F.broadcast(store.manifest.select("part", "first")), "part")
    recipes = recipes.withColumn("start", F.col("first") + F.col("inside"))
    rows = map_arrow(recipes.select("part", "pos", "doc_id", "start", "n_tokens", "names", "sizes", "root"), unfold, "part int, pos long, doc_id long, start long, digest binary, size long, after long, root_good boolean")
    met = rows.join(checked, "digest", "left").withColumn("placed", placed("crc", "after"))
    return (
        met.groupBy("part", "pos")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("start").alias("start"),
            F.sum("n").alias("n_tokens"),
            F.bit_xor("placed").alias("ids_crc32"),
            F.count("*").alias("n_chunks"),
            F.every(F.col("root_good") & F.coalesce(F.col("good") & (F.col("n") == F.col("size")), F.lit(False))).alias("verified"),
        )
        .drop("part", "pos")
    )


def token_output(docs: DataFrame) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads it back."""
    return read_back(write(docs, f"{shared_folder(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"))
