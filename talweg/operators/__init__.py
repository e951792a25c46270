"""Terrain operators: DataFrames of cells in, DataFrames out."""
