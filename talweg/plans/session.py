"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; iterative operators cut their plans with it.

    The folder is the session's ``spark.checkpoint.dir``; only a single-JVM session
    without one gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="talweg-"))
    return _without_estimates(df.checkpoint())


def _without_estimates(df: DataFrame) -> DataFrame:
    """The same rows as a new source for the planner.

    A checkpoint hands on the size that its plan was estimated to have.  A join is estimated as
    the product of its sides, so over a loop of joins the number of digits doubles each
    round, until the driver's heap is full of them.  A plain source has the default size.
    """
    spark, q = df.sparkSession, df._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(q.toRdd(), df._jdf.schema(), False), spark)
