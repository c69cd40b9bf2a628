"""Helpers that the corpus operators share: shared-folder tables, Arrow batch loops, words, ordered prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step inside a task works on; bounds the temporary arrays of a step, not the task.
STEP_BYTES = 1 << 19

#: Words of a generation (see Interned) where much is kept of each word.
CACHE_WORDS = 20_000

#: Bytes of a batch that travels to a Python worker, where the user has set no limit of their own.
BATCH_BYTES = 4 << 20

#: Rows up to which a side that grows with the data is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset, and only for a local master: elsewhere a
    folder of this machine would not be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='pulseforge-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes, after which a worker keeps no words and no free memory."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(limit):
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            Interned.release()
            give_back()

    return df.mapInArrow(ending, schema)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """df's partitions through step, a slice of at most about STEP_BYTES (or one row) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return in_batches(df, run, schema)


def give_back() -> None:
    """Returns what is free in this worker's heaps to the system: the worker stays for other tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batch: pa.RecordBatch, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    rows = max(1, step_bytes // per_row)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Interned(dict):
    """Numbers for words, given on first sight. fill(new words) is told of new ones, once each.

    Words that were not met for some time lose their number: once there are limit, they become the old generation, from which
    those that are met again move on, and the generation before is forgotten. What fill has kept of all words is cleared,
    and the numbers begin anew, after six times as many. A Python worker serves one task after another: it holds the words of
    one operator at a time, and of none between tasks (see in_batches).
    """

    active: Interned | None = None

    def __init__(self, fill: Callable[[list], None], clear: Callable[[], None], limit: int = 250_000):
        super().__init__()
        self.old: dict = {}
        self.total, self.fill, self.forget, self.limit = 0, fill, clear, limit

    @classmethod
    def release(cls) -> None:
        if cls.active is not None:
            cls.active.reset()
            cls.active = None

    def reset(self) -> None:
        self.clear()
        self.old, self.total = {}, 0
        self.forget()

    def numbers(self, words: list | pa.Array) -> np.ndarray:
        if Interned.active is not self:
            Interned.release()
            Interned.active = self
        if self.total > 6 * self.limit:
            self.reset()
        elif len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        if not len(words):
            return np.empty(0, np.int64)
        coded = (words if isinstance(words, pa.Array) else pa.array(words)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unknown = [w for w in distinct if w not in self]
        if self.old:
            again = [w for w in unknown if w in self.old]
            self.update(zip(again, map(self.old.__getitem__, again), strict=True))
            unknown = [w for w in unknown if w not in self.old]
        if unknown:
            self.update(zip(unknown, range(self.total, self.total + len(unknown)), strict=True))
            self.total += len(unknown)
            self.fill(unknown)
        number = np.fromiter(map(self.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return number[coded.indices.to_numpy()]


class Growing:
    """A numpy array with room to append to."""

    def __init__(self, dtype, width: int = 0):
        self.width, self.dtype = width, dtype
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.data = np.empty((1024, self.width) if self.width else 1024, self.dtype)

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            more = np.empty((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : need] = values
        self.n = need


def running_sums(df: DataFrame, key: str, order: list[str], value: str, name: str, head: str | None = None) -> DataFrame:
    """df plus part, pos (a row's place; unique together) and before: the sum of value over the earlier rows of its key; with
    head also first: the value that head has in the key's first row.

    Rows are ordered by key (null last), then order. A key may hold any share of the rows: ranges of rows go to
    different tasks, each sums on its own, and what a key has in earlier ranges is added by a join with one row at most
    per range. df should be a stored table, as range partitioning reads it twice.
    """
    spark = df.sparkSession
    sort = [F.col(key).isNull(), F.col(key), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    schema = T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType()), T.StructField("first", T.LongType())])
    heads = head or value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, total, first = False, None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.r_[not begun or b.column(key)[0].as_py() != last, keys[1:] != keys[:-1]]
            group = np.cumsum(new)  # 0: goes on from the batch before
            at = np.flatnonzero(new)
            sums = np.cumsum(v) - v
            before = sums - np.r_[-total, sums[at]][group]
            firsts = np.r_[first, b.column(heads).to_numpy(zero_copy_only=False).astype(np.int64)[at]][group]
            begun, last, total, first = True, b.column(key)[b.num_rows - 1].as_py(), int(before[-1] + v[-1]), int(firsts[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before), pa.array(firsts)], names=[*b.schema.names, "before", "first"])

    local = stored(in_batches(ranged, run, schema), name)
    sums = local.groupBy("part", key).agg(F.sum(value).alias("_sum"), F.min_by("first", "pos").alias("_head"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A range goes on with one key at most, so this has fewer rows than there are ranges.
    carry = sums.select(F.col("part").alias("_part"), F.col(key).alias("_key"), F.sum("_sum").over(earlier).alias("_carry"), F.first("_head").over(earlier).alias("_first")).filter("_carry is not null")
    joined = local.join(F.broadcast(carry), (local["part"] == F.col("_part")) & local[key].eqNullSafe(F.col("_key")), "left")
    joined = joined.withColumn("before", F.col("before") + F.coalesce("_carry", F.lit(0))).withColumn("first", F.coalesce("_first", "first"))
    return joined.drop("_part", "_key", "_carry", "_first", *([] if head else ["first"]))
