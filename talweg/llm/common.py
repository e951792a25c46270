"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.plans import session

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White-space separated words, as a Java / RE2 pattern.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only in a single-JVM
    session (tests) may it be missing; a folder is made then.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="talweg-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, as texts are long: this bounds the memory of Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage, and the planner's estimates, with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return session.cut(df)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder then stays
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/talweg-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, key: str, order: str, value: str, out: str, ties: list[str] = ()) -> DataFrame:
    """Exclusive running sum of ``value`` by ``key`` in the order of the long hash ``order``.

    A hot key never meets in one task: rows are dealt by (key, top 12 bits of
    the hash), sums of those small buckets are accumulated apart, and added to the
    running sum within a bucket.  Null keys form one key.
    """
    b = f"__b_{out}"
    df = df.withColumn(b, F.shiftright(F.col(order), 52))
    sums = df.groupBy(F.col(key).alias("__k"), F.col(b).alias("__b")).agg(F.sum(value).alias("__s"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inner = Window.partitionBy(key, b).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, F.col(key).eqNullSafe(F.col("__k")) & (F.col(b) == F.col("__b")))
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__k", "__b", "__base", b)


def restricted(df: DataFrame, key: str, keys: DataFrame, row_bytes: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the checkpointed one-column ``keys``.

    The keys are counted; up to ``broadcast_bytes`` they are broadcast, beyond they are joined.
    """
    small = keys.count() * row_bytes <= broadcast_bytes
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (a, b) edges, root the smallest node of its component.

    Distributed union-find by alternating large and small stars: each round hangs
    the larger neighbours of a node on its smallest neighbour, then the smaller ones.
    The number of rounds is logarithmic in practice.  Minima are made by partial
    aggregation, and looked up by joins of checkpointed tables whose hot keys Spark splits.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct()
    e = cut(e)
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = cut(e.select(F.col("u").alias("x"), "v").join(least, "x").select("v", F.col("m").alias("u")).filter("v != u").distinct())
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        e = cut(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        # done when every node hangs on one node, which hangs on none
        n, nodes = e.agg(F.count("*"), F.count_distinct("v")).first()
        if n == nodes and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def part_count(rows: int, per_part: int, df: DataFrame) -> int:
    """Parts so that each holds about ``per_part`` of ``rows``, and no fewer than shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def dealt(part: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Arrays cut by part number: one row a part with the bytes of each array's slice."""
    # few parts sort faster as 16-bit numbers
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    sorted_parts = part[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_parts[1:] != sorted_parts[:-1]])) if len(part) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(part)]]).astype(np.int64) if len(part) else begin
    cols = [pa.array(sorted_parts[begin].astype(np.int32))]
    for a in arrays:
        a = a[order]
        cols.append(pa.array([a[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["part", *(f"a{i}" for i in range(len(arrays)))])


def gathered(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The array whose slices ``dealt`` has sent to one part."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
