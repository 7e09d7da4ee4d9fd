"""Shared helpers: the shared folder, written intermediate tables, distributed ranks, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting for dropping a job's shuffle files as soon as it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="rootgraph-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    """Writes Parquet and drops the job's shuffle files when it ends: what follows reads the written table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more: what came of them is written as well."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to meet no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def pin(value: Column) -> Column:
    """``value`` as a generator of one row: the optimizer does not copy it into each place that uses it, lambdas included."""
    return F.explode(F.array(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the 0-based gapless rank in its group, without a window over a whole group.

    Rows are range-sorted and written with their row number; a count for each (partition, group), of
    which there are at most partitions + groups, gives each partition's offset. Group columns hold no nulls.
    """
    at = "_row"
    sort = [*group, *order]
    rows = written(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33).alias("_part")
    per = rows.groupBy(*group, part).agg(F.min(at).alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    joined = rows.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(per), [*group, "_part"])
    return joined.withColumn(name, F.col(at) + F.col("_shift")).drop(at, "_part", "_shift")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of undirected links: written (node, component = smallest node), nodes with links only.

    Alternates large-star and small-star steps; each is a min aggregate and a join, so no neighbour list is
    ever gathered, and each round is written and its predecessor deleted. ``a`` and ``b`` are of one orderable type, without nulls.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "cc")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every neighbour larger than u is linked to u's smallest neighbour (or u itself)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small-star: u's smaller neighbours and u itself are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.where("u != v").distinct(), "cc")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()).distinct(), "components")
    discard(edges)
    return out
