"""Rooted-graph descriptors and similarity analytics on PySpark."""
