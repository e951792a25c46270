"""Sources and sinks: GeoTIFF rasters, GeoPackage layers, points."""
