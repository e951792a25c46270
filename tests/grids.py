"""Grids from nested lists, and back."""

import numpy as np


def grid(spark, values, name, kind, nodata=None):
    cast = float if kind in ("float", "double") else int
    rows = [(r, c, None if nodata is not None and v == nodata else cast(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"row long, col long, {name} {kind}")


def dense(df, name, shape, missing=np.nan):
    out = np.full(shape, missing, float)
    for r in df.collect():
        out[r["row"], r["col"]] = missing if r[name] is None else r[name]
    return out
