"""Scalar functions that statements of the engine rely on; all are Spark's own."""
