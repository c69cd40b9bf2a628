"""Jaccard join on word shingles, exact, and its connected components.

Documents become sorted sets of 64-bit hashes of their word n-grams. Linked sets differ in at most D elements, where D
follows from the threshold and the sizes. So sizes fall into bands; each band cuts the hash space into k > D equal segments,
and linked sets agree in some whole segment. A tile holds the sets of one band that agree in one segment.

Empty segments agree too easily. A band has x more segments than D + 1; a set with up to x empty ones shares a non-empty one
with every partner, and only a set with more also enters tiles of its empty segments.

In a tile, each set is first compared with the tile's smallest document alone. Where that leaves a tile of three or more in
several components, all its pairs across components are compared. A comparison first bounds the overlap from above by the number of
differing bits of two parity bitmaps (8 bits or more for each element), and only what passes is intersected exactly.

Equal sets within a task fold into one before anything is shuffled, and each task sends one row per tile, so that a group of
copies of any size reaches a tile as one row per task.

Words are runs of other than ASCII white space, with A-Z in lower case. With fewer words than n, the whole sequence is the one
shingle; null and empty texts have an empty set and are linked with nothing. Rows with the same doc_id are one node: a link
of any of them is a link of it; rows with null doc_id have null component. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, CACHE_WORDS, Growing, Interned, in_batches, map_arrow, mix64, slices, stored, utf8
from .components import components

BAND_RATIO = Fraction(4, 3)
#: Rows that a task gathers before it folds them tile by tile.
FOLD_ROWS = 400_000
#: Members of a tile that are compared in one piece.
TILE_BLOCK = 512

_base = np.uint64(0x9E3779B97F4A7C15)
_hashes = Growing(np.uint64)
_words = Interned(lambda new: _hashes.extend(mix64(np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64))), _hashes.clear, CACHE_WORDS)


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' sets, each sorted and distinct, one after another; and the sets' sizes."""
    found = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    number = _words.numbers([w for f in found for w in f])
    h = _hashes.data[number]
    parts = []
    at = 0
    for size in sizes.tolist():
        own, at = h[at : at + size], at + size
        width = min(n, size)
        if not width:
            parts.append(own)
            continue
        roll = own[: size - width + 1].copy()
        for j in range(1, width):
            roll = roll * _base + own[j : size - width + 1 + j]
        if width < n:
            roll = roll + np.uint64(width)
        roll = mix64(roll)
        roll.sort()
        parts.append(roll[np.r_[True, roll[1:] != roll[:-1]]])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


class Bands:
    """Bands of set sizes for a threshold, a fraction."""

    def __init__(self, threshold: Fraction):
        self.threshold, self.least = threshold, [1]
        self.segments: list[int] = []
        self.spare: list[int] = []

    def grow(self, size: int) -> None:
        while self.least[-1] <= size:
            low = self.least[-1]
            high = max(low, int(low * BAND_RATIO) - 1)
            self.least.append(high + 1)
            # The smaller of a pair has up to high elements, the larger up to high / threshold.
            differ = int(high * (1 - self.threshold) / self.threshold)
            spare = 0
            for _ in range(3):
                mean = low / (differ + 1 + spare)
                spare = 2 + int(1.5 * np.exp(-mean) * (differ + 1 + spare)) if differ else 0
            self.segments.append(differ + 1 + spare)
            self.spare.append(spare)

    def of(self, size: int) -> list[int]:
        """The band of the size, and those below that have partners of it."""
        self.grow(size)
        own = int(np.searchsorted(self.least, size, side="right")) - 1
        out = [own]
        while out[-1] and self.least[out[-1]] - 1 >= self.threshold * size:
            out.append(out[-1] - 1)
        return out

    def tiles(self, hashes: np.ndarray) -> np.ndarray:
        """Names of the tiles that a set is in."""
        sums = np.r_[np.uint64(0), np.cumsum(mix64(hashes ^ _base), dtype=np.uint64)]
        out = []
        for band in self.of(len(hashes)):
            k = self.segments[band]
            # Segment of a hash: its high 32 bits scaled to k; sorted hashes make it ascend.
            segment = ((hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(segment, np.arange(k + 1))
            filled = np.flatnonzero(edges[1:] > edges[:-1])
            name = lambda seg, content: mix64(content + mix64((np.uint64(band << 32) + seg.astype(np.uint64)) * _base))  # noqa: B023, E731
            out.append(name(filled, sums[edges[filled + 1]] - sums[edges[filled]]))
            if k - len(filled) > self.spare[band]:
                empty = np.flatnonzero(edges[1:] == edges[:-1])
                out.append(name(empty, np.full(len(empty), 0x5851F42D4C957F2D, np.uint64)))
        return np.concatenate(out)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of the elements by their low bits, with at least 8 bits for each element: uint64 words."""
    bits = max(64, 1 << (8 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def enough(overlap, size_a, size_b, threshold: Fraction):
    return overlap * (threshold.denominator + threshold.numerator) >= threshold.numerator * (size_a + size_b)


#: kind 0: a document lo with hi shingles; 1: lo and hi have equal sets; 2: lo and hi share tile; 3: lo is in tile.
_ROWS = "kind byte, tile long, lo long, hi long"
_NAMES = ["kind", "tile", "lo", "hi"]


def _rows(kind: int, tile, lo, hi) -> pa.RecordBatch:
    n = len(lo)
    column = lambda x: pa.array(np.asarray(x).astype(np.int64)) if x is not None else pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), column(tile), lo if isinstance(lo, pa.Array) else column(lo), column(hi)], names=_NAMES)


def shared_tiles(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Rows of kinds 0, 1 and 2 of docs(doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(threshold), {}
        tiles, owners, same, held = [], [], [], 0

        def fold() -> Iterator[pa.RecordBatch]:
            if same:
                yield _rows(1, None, *np.array(same, np.int64).T)
            if tiles:
                tile = np.concatenate(tiles).view(np.int64)
                owner = np.repeat(np.array([o for o, _ in owners], np.int64), [c for _, c in owners])
                order = np.lexsort((owner, tile))
                tile, owner = tile[order], owner[order]
                new = np.r_[True, tile[1:] != tile[:-1]]
                first = owner[new]
                yield _rows(3, tile[new], first, None)
                rest = ~new
                if rest.any():
                    yield _rows(2, tile[rest], first[np.cumsum(new) - 1][rest], owner[rest])

        for batch in batches:
            for b in slices(batch):
                hashes, sizes = shingle_sets(utf8(b.column(1)), n)
                yield _rows(0, None, b.column(0), sizes)
                at = 0
                for doc, size in zip(b.column(0).to_pylist(), sizes.tolist(), strict=True):
                    own, at = hashes[at : at + size], at + size
                    if doc is None or not size:
                        continue
                    key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    if key in seen:
                        same.append((seen[key], doc))
                        continue
                    seen[key] = doc
                    tiles.append(bands.tiles(own))
                    owners.append((doc, len(tiles[-1])))
                    held += len(tiles[-1])
                if held > FOLD_ROWS:
                    yield from fold()
                    tiles, owners, same, held = [], [], [], 0
        yield from fold()

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile and lo: members of a tile are set against its first."""
        last, pivot = None, 0
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            if (kind != 3).any():
                yield b.filter(pa.array(kind != 3))
            here = b.filter(pa.array(kind == 3))
            if not here.num_rows:
                continue
            tile, lo = here.column(1).to_numpy(zero_copy_only=False), here.column(2).to_numpy(zero_copy_only=False)
            new = np.r_[tile[0] != last, tile[1:] != tile[:-1]]
            pivots = np.r_[pivot, lo[new]][np.cumsum(new)]
            last, pivot = tile[-1], pivots[-1]
            rest = ~new & (pivots != lo)
            if rest.any():
                yield _rows(2, tile[rest], pivots[rest], lo[rest])

    made = in_batches(docs, cut, _ROWS)
    # Only the members of tiles have to meet; rows that star passes on go anywhere.
    key = F.when(F.col("kind") == 3, F.col("tile")).otherwise(F.xxhash64("lo", "hi", "tile"))
    return in_batches(made.repartition(key).sortWithinPartitions("tile", "lo"), star, _ROWS)


def narrowed(df: DataFrame, ids: DataFrame, rows: int, column: str) -> DataFrame:
    """The rows of df whose column is in ids(column)."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, column, "left_semi")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, bits, hashes) of docs(doc_id, text)."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, sizes = shingle_sets(utf8(b.column(1)), n)
        ends = np.cumsum(sizes)
        own = [hashes[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array([bitmap(x).tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["doc_id", "size", "bits", "hashes"])

    return map_arrow(docs, step, "doc_id long, size long, bits binary, hashes binary")


def linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (lo, hi) whose sets are linked."""

    def bound(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for sa, sb, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            keep.append(bool(enough((sa + sb - differ) // 2, sa, sb, threshold)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["lo", "hi"]).filter(pa.array(keep))

    def exact(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            keep.append(bool(enough(int((both[1:] == both[:-1]).sum()), len(x), len(y), threshold)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["lo", "hi"]).filter(pa.array(keep))

    def with_both(p: DataFrame, *columns: str) -> DataFrame:
        for end in ("hi", "lo"):
            p = p.join(sets.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return p.select("lo", "hi", *[f"{c}_{end}" for c in columns for end in ("lo", "hi")])

    near = stored(map_arrow(with_both(pairs, "size", "bits"), bound, "lo long, hi long").distinct(), "join-near")
    return stored(map_arrow(with_both(near, "hashes"), exact, "lo long, hi long").distinct(), "join-links")


def allowed(a: int, others: np.ndarray, size: np.ndarray, table: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Those of others whose sizes and bitmaps let them be linked with a."""
    others = others[enough(np.minimum(size[others], size[a]), size[others], size[a], threshold)]
    if len(others):
        differ = np.bitwise_count(table[others] ^ table[a]).sum(axis=1, dtype=np.int64)
        others = others[enough((size[others] + size[a] - differ) // 2, size[others], size[a], threshold)]
    return others


def by_group(df: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """work(rows of a group as lists by column) for every group of keys; a task streams over its sorted groups, one in memory at a time."""
    order, n = [*keys, *columns], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32()}
        kinds = [types[c.split()[1]] for c in schema.split(", ")]
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != now:
                    if held:
                        out += work(now, list(zip(*held, strict=True)))
                    now, held = row[:n], []
                held.append(row[n:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out = work(now, list(zip(*held, strict=True))) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return in_batches(df.select(order).repartition(*keys).sortWithinPartitions(*keys), run, schema)


def across(members: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (lo, hi) between members (tile, doc_id, component) of a tile in different components: enough of them to connect all that are linked.

    Bitmaps first tell which members could have such a link at all; only for those are the sets brought into the tile.
    """

    def arrays(rows: list, side_at: int) -> tuple:
        maps = [np.frombuffer(x, "<u8") for x in rows[3]]
        least = min(len(m) for m in maps)
        return np.array(rows[0]), np.array(rows[1]), np.array(rows[2]), np.stack([folded(m, least) for m in maps]), np.array(rows[side_at])

    def others_of(a: int, comp: np.ndarray, doc: np.ndarray, side: np.ndarray) -> np.ndarray:
        return np.flatnonzero((comp != comp[a]) & ((side == 1) if side[a] == 0 else (doc > doc[a])))

    def near(key: tuple, rows: list) -> list:
        doc, comp, size, table, side = arrays(rows, 4)
        open_ = np.zeros(len(doc), bool)
        for a in np.flatnonzero(side != 1):
            found = allowed(a, others_of(a, comp, doc, side), size, table, threshold)
            open_[found] = True
            open_[a] |= len(found) > 0
        return [(*key, int(doc[k]), int(side[k])) for k in np.flatnonzero(open_)]

    def join(key: tuple, rows: list) -> list:
        doc, comp, size, table, side = arrays(rows, 5)
        held = [np.frombuffer(x, "<u8") for x in rows[4]]
        out, comp = [], comp.copy()
        for a in np.flatnonzero(side != 1):
            for b in allowed(a, others_of(a, comp, doc, side), size, table, threshold):
                if comp[a] != comp[b]:
                    both = np.concatenate([held[a], held[b]])
                    both.sort(kind="stable")
                    if enough(int((both[1:] == both[:-1]).sum()), int(size[a]), int(size[b]), threshold):
                        out.append((int(min(doc[a], doc[b])), int(max(doc[a], doc[b]))))
                        comp[comp == comp[b]] = comp[a]
        return out

    # Large tiles are dealt out as pairs of blocks; side says which block of the pair a member is of (2: both are one).
    # Only tiles of more than a block are named, so that no tile's members have to meet in a join by tile.
    large = members.groupBy("tile").agg(F.ceil(F.count("*") / TILE_BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    large = stored(large, "join-blocks")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    dealt = members.join(large, "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    keys = ["tile", "x", "y"]
    mapped = dealt.join(sets.select("doc_id", "size", "bits"), "doc_id")
    open_ = by_group(mapped, keys, ["doc_id", "component", "size", "bits", "side"], near, "tile long, x int, y int, doc_id long, side int")
    open_ = stored(open_, "join-open").join(members.select("doc_id", "component").distinct(), "doc_id").join(sets, "doc_id")
    return by_group(open_, keys, ["doc_id", "component", "size", "bits", "hashes", "side"], join, "lo long, hi long").distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least the threshold)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(shared_tiles(texts, n, threshold), "join-tiles")
    same, tiles = found.filter("kind = 1").select("lo", "hi"), found.filter("kind = 2").select("tile", "lo", "hi")
    pairs = stored(tiles.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct(), "join-pairs")
    ids = stored(pairs.select(F.explode(F.array("lo", "hi")).alias("doc_id")).distinct(), "join-ids")
    sets = stored(sets_of(narrowed(texts, ids, ids.count(), "doc_id"), n), "join-sets")
    links = linked(pairs, sets, threshold).unionByName(same)
    # Tiles that these links leave in several components. A tile of two has had its pair compared; tiles of the same members count once.
    parts = components(links)
    members = tiles.select("tile", F.explode(F.array("lo", "hi")).alias("doc_id")).distinct()
    members = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    alike = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b")]
    split = members.groupBy("tile").agg(*alike, F.min("component").alias("least"), F.max("component").alias("most")).filter("n > 2 and least < most")
    split = split.groupBy("n", "a", "b").agg(F.min("tile").alias("tile")).select("tile")
    members = stored(members.join(split, "tile", "left_semi"), "join-members")
    if members.count():
        links = links.unionByName(stored(across(members, sets, threshold), "join-across"))
        parts = components(links)
    rows = found.filter("kind = 0").selectExpr("lo as doc_id", "hi as n_shingles")
    return rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """The rows of docs (doc_id, text and others) whose doc_id is the smallest of its component, or null."""
    made = stored(ngram_jaccard_join(docs, n, threshold), "join-rows")
    gone = made.filter("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
     ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""
