"""Continuous conditioning: whole grids arriving in a stream, one result for each."""
