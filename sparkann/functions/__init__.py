"""Scalar column functions: distances and hashes."""
