"""What the training-data operators share: the shared folder, written intermediate tables, bounded Bloom filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text everywhere in this subpackage: maximal runs of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir[app] = tempfile.mkdtemp(prefix="quantloom-")
    return _own_dir[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and lost executors lose none of it."""
    path = f"{shared_dir(df.sparkSession)}/quantloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize wrote and that no later step reads."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for name in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def frugal(run):
    """run, a function from Arrow batches to Arrow batches, giving freed memory back to the system when a task ends:
    Python workers are used again, and what their allocators keep would count against every later task."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return task


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Tables that are written inside go to Python by n rows: batches of long texts fill executors outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (vectorised)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- Bloom filters sized by their keys, up to a bound: past it they pass everything, so results never depend on them ---


def filter_size(keys: int, most: int, least: int = 10) -> int:
    """log2 of a filter's words: sixteen bits a key, at most 2**most words."""
    return min(most, max(least, (keys // 4).bit_length()))


def bloom_words(keys: DataFrame, col: str, log2_words: int) -> DataFrame:
    """(word int, bits long), at most 2**log2_words rows: two bits for each key. col: a long with well mixed bits."""
    n = 1 << (log2_words + 6)
    bit = F.explode(F.array(F.col(col).bitwiseAND(n - 1), F.shiftrightunsigned(col, 28).bitwiseAND(n - 1))).alias("b")
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    return keys.select(bit).groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))


def bloom_array(keys: DataFrame, col: str, most: int = 22) -> np.ndarray:
    """The filter as unsigned words on the driver, sized by the number of keys; 32 MB at most."""
    log2_words = filter_size(keys.count(), most)
    t = bloom_words(keys, col, log2_words).toArrow()
    out = np.zeros(1 << log2_words, np.uint64)
    out[t["word"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return out


def bloom_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    n = np.uint64(len(bits) * 64 - 1)
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    hit = np.ones(len(keys), bool)
    for b in (keys & n, (keys >> np.uint64(28)) & n):
        hit &= (bits[b >> six] >> (b & low)) & one == one
    return hit


def split_by_keys(df: DataFrame, keys: DataFrame, on: list[str], most: int = 19) -> tuple[DataFrame, DataFrame]:
    """(rows whose `on` may be in keys, rows whose `on` surely is not), without a shuffle of df.

    The filter is a broadcast table sized by the number of keys (a written table, read twice), of at most 2**19 rows;
    when keys outgrow it, all rows come back as "may be" and the caller's join does the whole work."""
    log2_words = filter_size(keys.count(), most)
    n = 1 << (log2_words + 6)
    filt = bloom_words(keys.select(F.xxhash64(*on).alias("_h")), "_h", log2_words)
    h = F.xxhash64(*on)
    b1, b2 = h.bitwiseAND(n - 1), F.shiftrightunsigned(h, 28).bitwiseAND(n - 1)
    one, two = (
        F.broadcast(filt.select(F.col("word").alias(f"_w{i}"), F.col("bits").alias(f"_b{i}"))) for i in (1, 2)
    )
    probed = (
        df.withColumns({"_k1": b1, "_k2": b2})
        .join(one, F.shiftright("_k1", 6).cast("int") == F.col("_w1"), "left")
        .join(two, F.shiftright("_k2", 6).cast("int") == F.col("_w2"), "left")
    )
    has = lambda i: F.expr(f"coalesce((shiftrightunsigned(_b{i}, cast(_k{i} & 63 as int)) & 1) = 1, false)")
    flagged = probed.withColumn("_maybe", has(1) & has(2))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return flagged.where("_maybe").select(*keep), flagged.where("not _maybe").select(*keep)
