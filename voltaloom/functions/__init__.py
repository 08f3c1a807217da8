"""Scalar functions, signal kernels and statistics."""
