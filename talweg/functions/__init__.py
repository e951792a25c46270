"""Scalar functions: units and geometry."""
