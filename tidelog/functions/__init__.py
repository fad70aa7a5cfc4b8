"""Scalar functions of the storage layer."""
