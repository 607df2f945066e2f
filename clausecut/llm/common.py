"""What the operators of this folder share: scratch tables, word patterns, prefix sums that split hot groups."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="clausecut-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


class Scratch:
    """Parquet tables under the shared folder. They cut lineage: a lost executor costs no more than the tasks since the last table.

    A table stays until drop(name) or drop(): a lazy result may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/clausecut-{label}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[str, str] = {}
        self.schemas: dict[str, StructType] = {}

    def write(self, df: DataFrame, name: str, compact: bool = False) -> DataFrame:
        """compact: for rows that are much smaller than what they were made from; they go to few files of a good size."""
        self.n += 1
        path = self.paths[name] = f"{self.root}/{self.n:03d}-{name}"
        (df.hint("rebalance") if compact else df).write.parquet(path)
        self.schemas[name] = df.schema
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """A table written before and not dropped."""
        return self.spark.read.schema(self.schemas[name]).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                p = hadoop(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def forget_shuffles(self) -> None:
        """Spark deletes the shuffles of plans that the driver has no more references to, but looks for them only when its memory is collected; so it is, after jobs that shuffled much."""
        self.spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free(taken, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of those taken (Spark tells no case) and none of the others."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def digest(value: Column, seed: int = 0) -> tuple[Column, Column]:
    """128 bits in two longs; another seed gives other, unrelated bits."""
    return F.xxhash64(F.lit(2 * seed + 1), value), F.xxhash64(F.lit(-2 * seed - 2), value)


def chunk_bits(rows: int, rows_each: int = 1024, most: int = 20) -> int:
    """Bits of an order's hash that cut each group in chunks of about rows_each rows, were all rows in one group."""
    return max(0, min(most, math.ceil(math.log2(max(1, rows) / rows_each)))) if rows > rows_each else 0


def top_bits(value: Column, bits: int) -> Column:
    """The top bits of a long as a small number that rises with the long taken as unsigned."""
    return F.shiftrightunsigned(value, 64 - bits) if bits else F.lit(0).cast("long")


def running(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, out: str, totals: DataFrame | None = None) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group that come before, by (chunk, order).

    Sums of chunks are small and get a window over the group; rows get one only within (group, chunk), so that no
    task holds a hot group. df is read twice: it must be a table or otherwise the same each time.
    """
    by = [*group, chunk]  # without a group, chunks' sums are one small window
    if totals is None:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
        totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return df.withColumn("_in", inside).join(totals, by).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def broadcast_if_small(df: DataFrame, rows: int, bytes_each: int, most_bytes: int = 8 << 20) -> DataFrame:
    """A broadcast hint if rows, which the caller has counted, can't pass most_bytes; else df as it is, for a shuffle join."""
    return F.broadcast(df) if rows * bytes_each <= most_bytes else df


def by_key(batches, *keys: str):
    """From pandas batches sorted by keys, lots of rows that hold every key they hold whole: a worker has one batch, and what rows its first key had before."""
    import numpy as np
    import pandas as pd

    held = []  # rows of the key that the batches so far end with
    for b in batches:
        if not len(b):
            continue
        columns = [b[k].to_numpy() for k in keys]
        if held and any(c[0] != held[-1][k].iloc[-1] for k, c in zip(keys, columns, strict=True)):
            yield pd.concat(held, ignore_index=True)
            held = []
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = len(b) - int(last.sum())
        if cut:
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def trimmed() -> None:
    """Gives a worker's freed memory back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """f over the batches of a partition; then the worker, which lives on for other tasks, gives freed memory back to the system."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        trimmed()

    return run
