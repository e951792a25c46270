"""Apply a grid operator to the grids of each micro-batch.

A grid must arrive whole in one batch, as global operators need all its cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_grid(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, grid: str = "grid_id") -> StreamingQuery:
    """Write ``operator`` of every grid of the stream (grid, row, col, z) to ``path``, by grid and batch.

    A batch that is run again after a failure overwrites what it wrote before.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for (g,) in df.select(grid).distinct().toLocalIterator():
            cells = df.filter(F.col(grid) == F.lit(g)).drop(grid)
            operator(cells).write.mode("overwrite").parquet(f"{path}/{grid}={g}/batch={number}")
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
