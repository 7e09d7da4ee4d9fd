"""Job 1, batch: screens a library of binary descriptors against itself.

Reads vectors with a class, refuses unsound rows into a table of their own, takes the signs of the first components as
a binary descriptor, finds the nearest neighbours of every row with the bit-count index, and says for each class how far
its neighbours are of its own kind.

    python -m jobs.library_screen --config jobs/library_screen.json --set output=/data/screen
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, told
from rootgraph.functions.bits import pack, popcount
from rootgraph.operators.nearest import nearest
from rootgraph.plans.fixtures import sign_bits


@dataclass(frozen=True)
class Config:
    source: str
    output: str
    bits: int = 64
    k: int = 10
    #: classes whose rows are screened (against all rows); all if null
    classes: list[int] | None = None


def fault(bits: int) -> Column:
    """What makes a row unusable, or null."""
    v = F.col("embedding")
    return (
        F.when(F.col("vec_id").isNull(), "no id")
        .when(v.isNull() | (F.size(v) < bits), "too short")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    )


def run(spark: SparkSession, config: Config) -> dict:
    """Writes under ``output``: rejected, neighbours and classes, the last two partitioned by label.

    With all classes each table is written anew; with some, only the partitions of these are replaced, so reruns and
    screens of single classes leave the same table. Rows of a null label form a class of their own. Returns what was
    read, compared and written. Ids are taken as unique.
    """
    if config.bits < 1 or config.k < 1:
        raise ValueError("bits and k are positive")
    read, seen = Observation(), (Observation(), Observation())
    rows = spark.read.parquet(config.source).select("vec_id", "label", "embedding").withColumn("fault", fault(config.bits))
    rows.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("fault").isNotNull()).alias("rejected")).where("fault is not null").select("vec_id", "label", "fault").write.mode("overwrite").parquet(f"{config.output}/rejected")
    n_words = -(-config.bits // 64)
    library = rows.where("fault is null").select("vec_id", "label", pack(sign_bits(0, config.bits), config.bits).alias("words"))
    asked = library if config.classes is None else library.where(F.col("label").isin(*config.classes))

    found = nearest(asked, library, "vec_id", "words", n_words, config.k, compared=seen)
    sides = lambda s: library.select(F.col("vec_id").alias(s), F.col("label").alias(f"{s}_label"), popcount(F.col("words"), n_words).cast("int").alias(f"{s}_on"))
    found = found.join(sides("query"), "query").join(sides("match"), "match")
    same = F.col("query_label").eqNullSafe(F.col("match_label"))
    found = found.select("query", "rank", "match", "similarity", "query_on", "match_on", same.alias("same_class"), F.col("query_label").alias("label"))
    at = _replace(found, f"{config.output}/neighbours", config)

    near = spark.read.schema(found.schema).parquet(at)
    near = near if config.classes is None else near.where(F.col("label").isin(*config.classes))
    classes = near.groupBy("label").agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_neighbours"), F.avg("similarity").alias("mean_similarity"), F.avg(F.col("same_class").cast("double")).alias("same_class_fraction"), F.avg(F.when(F.col("rank") == 1, F.col("same_class").cast("double"))).alias("nearest_same_class"))
    _replace(classes, f"{config.output}/classes", config)
    done = {"source": config.source, **read.get, "pairs_compared": sum(s.get["n"] for s in seen), "output": config.output, "neighbours": near.count()}
    told("library_screen", **done)
    return done


def _replace(df: DataFrame, path: str, config: Config) -> str:
    mode = "static" if config.classes is None else "dynamic"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("label").parquet(path)
    return path


def neighbours(spark: SparkSession, output: str) -> DataFrame:
    """The neighbour table of an output, its partition column typed as written."""
    schema = "query bigint, rank int, match bigint, similarity double, query_on int, match_on int, same_class boolean, label bigint"
    return spark.read.schema(schema).parquet(f"{output}/neighbours")


if __name__ == "__main__":
    command("library_screen", Config, run)
