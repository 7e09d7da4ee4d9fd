"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: rows of a small side up to which it is broadcast
SMALL = 20_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode an own folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="rootgraph-")
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own: computed once, its lineage cut, safe from lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Joins ``small``, which holds few rows for each key, to rows whose keys may be hot.

    It is broadcast if a count shows that it has at most ``SMALL`` rows; otherwise every key is dealt over ``salts``
    parts, for which ``small`` is repeated. Without key columns ``small`` is one row.
    """
    if not on or small.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(small), on, how) if on else rows.crossJoin(F.broadcast(small))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(salts)).cast("int"))
    return own.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"], how).drop("_salt")
