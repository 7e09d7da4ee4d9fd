"""Descriptors over streams: a stateless projection, the same as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootgraph.functions import bits, smiles
from rootgraph.operators import graph


def stream_fingerprints(df: DataFrame, column: str, radius: int = 3, n_bits: int = 1024, marker: str = "Hg") -> DataFrame:
    """Adds on_bits, bitstring and error to a streaming (or batch) table of structures."""
    g = graph.wl_fingerprint(graph.rooted(smiles.read_graphs(df, column, marker)), radius, n_bits)
    return g.withColumn("bitstring", bits.bitstring(F.col("on_bits"), n_bits)).select(*df.columns, "on_bits", "bitstring", "error")
