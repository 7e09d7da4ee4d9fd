"""Runnable jobs over the given tables: a library screen (batch) and a descriptor feed (incremental)."""
