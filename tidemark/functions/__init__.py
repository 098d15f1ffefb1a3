"""Scalar column functions; every one is a built-in Column expression."""
