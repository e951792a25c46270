"""Points and other vector layers: GeoPackage, GeoJSON, CSV and Parquet.

A GeoPackage is a SQLite file, which one process reads and writes; rows stream through the driver.
"""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from talweg.functions.geometry import LINE, POINT, POLYGON, decode_wkb, encode_wkb

_NAMES = {POINT: "POINT", LINE: "LINESTRING", POLYGON: "POLYGON"}
_SQL = {"bigint": "INTEGER", "int": "MEDIUMINT", "double": "REAL", "string": "TEXT"}


def _blob(kind: int, xy: list[tuple[float, float]], srs: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + encode_wkb(kind, xy)


def _coords(blob: bytes) -> list[tuple[float, float]]:
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return decode_wkb(blob[8 + envelope :])[1]


def layers(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'")]


def gpkg_points(path: str, layer: str | None = None) -> Iterator[tuple]:
    """(fid, x, y) of a layer, by default the first; features without geometry are skipped."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        name = layer or layers(path)[0]
        geom = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()[0]
        key = next(r[1] for r in db.execute(f'PRAGMA table_info("{name}")') if r[5])
        for fid, blob in db.execute(f'SELECT "{key}", "{geom}" FROM "{name}"'):
            if blob is not None and (xy := _coords(blob)):
                yield fid, *xy[0]


def read_points(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(fid, x, y) of a .gpkg, .geojson, .csv (fid, x, y) or Parquet file, in the raster's coordinates."""
    schema = "fid long, x double, y double"
    if path.endswith(".gpkg"):
        return spark.createDataFrame(list(gpkg_points(path, layer)), schema)
    if path.endswith((".geojson", ".json")):
        with open(path) as f:
            found = json.load(f)["features"]
        rows = [(int(x.get("id", i)), float(x["geometry"]["coordinates"][0]), float(x["geometry"]["coordinates"][1])) for i, x in enumerate(found) if x.get("geometry")]
        return spark.createDataFrame(rows, schema)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.parquet(path).selectExpr("cast(fid AS long) AS fid", "cast(x AS double) AS x", "cast(y AS double) AS y")


def write_gpkg(path: str, tables: dict[str, tuple[DataFrame, int]], srs: int = 4326) -> None:
    """Layers {name: (rows, kind)}; rows have ``coords`` (or x and y for points) and attributes."""
    with sqlite3.connect(path) as db:
        db.executescript(
            """PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"""
        )
        db.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
        for name, (df, kind) in tables.items():
            fields = [(c, t) for c, t in df.dtypes if c not in ("coords", "x", "y", "fid") and t in _SQL]
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom {_NAMES[kind]}' + "".join(f', "{c}" {_SQL[t]}' for c, t in fields) + ")")
            db.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
            db.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, _NAMES[kind], srs))
            has_fid, marks = "fid" in df.columns, ", ".join("?" * (2 + len(fields)))
            for r in df.toLocalIterator():
                xy = [(r["x"], r["y"])] if "x" in df.columns else [(p["x"], p["y"]) for p in r["coords"]]
                db.execute(f'INSERT INTO "{name}" VALUES ({marks})', (r["fid"] if has_fid else None, _blob(kind, xy, srs), *(r[c] for c, _ in fields)))
