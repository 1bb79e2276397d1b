"""Scalar and text functions: columns where Spark can express them, Arrow batches where it cannot."""
