"""What the operators of this subpackage share: staging, size-checked joins, components, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a side may have to be broadcast, and what a row of a few numbers has.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 32

#: Rows that a Python worker is handed at once, where the session has Spark's default: texts make 10 000 rows heavy.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's spark.checkpoint.dir; only where it is unset and all runs on this machine a folder of our own, which
    goes with the process. RuntimeError on a cluster without it: other machines would not see a local folder.
    """
    bounded_batches(spark)
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="orrery-shared-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a file of the shared folder that results may need until the driver ends."""

    def run() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)

    atexit.register(run)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver's, written to any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a reliable checkpoint in the shared folder.

    With spark.cleaner.referenceTracking.cleanCheckpoints the context cleaner removes the files once nothing refers to
    them; without it they stay, as all checkpoints do.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hands what this process has freed back to the system; its allocators would keep it for themselves."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow whose Python worker, which waits for other tasks then, is left without what it held."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


class Staging:
    """Parquet tables in the shared folder that an operator needs while it runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_staged", None):
            delete(self.spark, path)

    def close(self) -> None:
        delete(self.spark, self.root)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None, bytes_: Column | None = None) -> DataFrame:
    """Broadcast right where its rows, counted here unless given, have BROADCAST_BYTES at most; else a shuffled join.

    A row counts as ROW_BYTES, and as bytes_ more where it has wide columns.
    """
    if bytes_ is not None:
        rows, more = right.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    else:
        rows, more = right.count() if rows is None else rows, 0
    return left.join(F.broadcast(right) if rows * ROW_BYTES + more <= BROADCAST_BYTES else right, on, how)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct named row, so that an operator's own names never clash with the caller's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(df.columns)]).alias("row"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def different_texts(stage: Staging, rows: DataFrame):
    """The different texts of a table (id, text) as a table (key long, first, last: least and greatest id), and the key of a text column.

    A key is a 64-bit hash; texts are told apart by 128 bits, and where two texts share a key, both get another one.
    """
    plain, second = lambda t: F.xxhash64(t), lambda t: F.xxhash64(F.lit(1), t)
    found = stage.table(rows.select(plain("text").alias("key"), second(F.col("text")).alias("check"), "id").groupBy("key", "check").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    clashes = [r["key"] for r in found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1001).collect()]
    if not clashes:
        return found.select("key", "first", "last"), plain
    if len(clashes) > 1000:
        raise RuntimeError("more than 1000 pairs of texts share a 64-bit hash")
    again = lambda key, check: F.when(key.isin(clashes), F.xxhash64(key, check)).otherwise(key)
    key_of = lambda t: again(plain(t), second(F.col(t) if isinstance(t, str) else t))
    return found.select(again(F.col("key"), F.col("check")).alias("key"), "first", "last"), key_of


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node long, root long), root the smallest node.

    Alternates large-star and small-star over tables in the shared folder until every node points at one root. Either
    step keeps the number of edges, and a node with very many neighbours meets them by hash aggregation and, in the
    join, behind AQE's skew split: no group is collected into one task. The rounds grow with the square of the
    logarithm of the nodes at most; max_rounds is far beyond. Only nodes that have an edge get a row.
    """
    stage = Staging(edges.sparkSession)
    now = stage.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    try:
        for _ in range(max_rounds):
            if now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi").isEmpty():
                break
            both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            held = stage.table(large)
            low = held.groupBy("a").agg(F.min("b").alias("m"))
            small = held.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
            new = stage.table(small.distinct())
            stage.drop(held)
            stage.drop(now)
            now = new
        else:
            raise RuntimeError("components did not settle")
        return cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    finally:
        stage.close()


# --- word hashing for the operators that run in Python -------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word to 64-bit hash, remembered; forgets all it holds when it grows past its bound."""

    bound = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes: position i stands for hashes[i : i + k]."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(base) + hashes[i : i + n]
    return mix64(out)
