"""Validated CSV sources and audited sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootgraph.operators.quantiles import running
from rootgraph.operators.stats import ordinal
from rootgraph.sources.shared import stored, with_small


class TableError(ValueError):
    """A table that breaks the rules of its kind."""


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """All columns as text, with source_row: the line of the file a row stands on, the header being line 1.

    The row's place is taken at the scan, before anything is dropped: files in order of name, rows in order within, each
    file having a header. A scan numbers the rows of its parts of files; counts of the parts, in order of file and
    offset, say where each begins. Several files count as one without the later headers.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if columns is not None:
        exact_columns(raw.columns, list(columns))
    names = [F.col("`" + c.replace("`", "``") + "`").cast("string").alias(f"c{k}") for k, c in enumerate(raw.columns)]
    place = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    rows = stored(raw.select(*names, *(c.alias(f"_{k}") for k, c in place.items())), "csv")
    parts = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    parts = running(parts, [], ["_file", "_start"], F.col("_n"), "_before")
    out = with_small(rows, parts.select("_file", "_start", (F.col("_before") - F.col("_least") + 2).alias("_shift")), ["_file", "_start"])
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(raw.columns)), (F.col("_at") + F.col("_shift")).alias("source_row"))


def exact_columns(found: list[str], wanted: list[str]) -> None:
    if list(found) != list(wanted):
        raise TableError(f"columns must be {wanted}, in this order, not {list(found)}")


def required_columns(found: list[str], wanted: list[str]) -> None:
    if missing := [c for c in wanted if c not in found]:
        raise TableError(f"missing columns: {missing}")


def numbered_columns(columns: list[str], prefix: str = "SMILES_") -> list[str]:
    """Columns prefix0, prefix1, ... in order of number; the numbers must run from 0 without a gap."""
    found = sorted((int(m[1]), c) for c in columns if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", c)))
    if not found or [k for k, _ in found] != list(range(len(found))):
        raise TableError(f"columns {prefix}<n> must be numbered from 0 without a gap")
    return [c for _, c in found]


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise TableError("the table has no rows")
    return df


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: blank values in each column, rows blank in all and in some but not all columns."""
    every, some = F.lit(True), F.lit(False)
    for c in columns:
        every, some = every & blank(c), some | blank(c)
    return df.agg(*(F.count_if(blank(c)).alias(f"{c}_blank") for c in columns), F.count_if(every).alias("rows_blank"), F.count_if(some & ~every).alias("rows_partly_blank"), F.count("*").alias("rows"))


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trims the columns, drops rows blank in all of them, rejects rows blank in some."""
    counts = blank_counts(df, columns).first()
    if counts["rows_partly_blank"]:
        raise TableError(f"{counts['rows_partly_blank']} rows are partly blank")
    every = F.lit(True)
    for c in columns:
        every = every & blank(c)
    return df.where(~every).withColumns({c: F.trim(c) for c in columns})


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if bad := duplicates(df, keys).limit(10).collect():
        raise TableError(f"{keys} repeat: {[tuple(r)[:-1] for r in bad]}")
    return df


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, a missing value counting as one."""
    n = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(key).agg(n.cast("long").alias("n_values")).where("n_values > 1")


def component_table(df: DataFrame, key: str, value: str, order: str = "source_row") -> DataFrame:
    """One row for each key, its first by ``order``; a key with several values is an error."""
    if bad := dependency_violations(df, key, value).limit(10).collect():
        raise TableError(f"{key} has several {value}: {[r[0] for r in bad]}")
    return df.groupBy(key).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def cartesian(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, distinct a and b, n_pairs, and whether all combinations are there once."""
    out = df.agg(F.count("*").alias("n"), F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"), F.count_distinct(a, b).alias("n_pairs"))
    return out.withColumn("complete", (F.col("n") == F.col("n_pairs")) & (F.col("n_pairs") == F.col("n_a") * F.col("n_b")))


def missing_combinations(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a).distinct().crossJoin(df.select(b).distinct()).join(df, [a, b], "left_anti")


def marker_count(c: Column, marker: str = "Hg") -> Column:
    token = f"[{marker}]"
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("int")


def marker_error(c: Column, marker: str = "Hg", connected: bool = True) -> Column:
    """What is wrong with a structure's text, or null: empty, not one marker, more than one component."""
    n = marker_count(c, marker)
    out = F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit("empty")).when(n != 1, F.concat(F.lit("markers: "), n.cast("string")))
    return out.when(c.contains("."), F.lit("disconnected")) if connected else out


def report(df: DataFrame, error: str, shown: int = 10) -> None:
    """Raises an error that names the first failures by source_row."""
    bad = df.where(F.col(error).isNotNull()).orderBy("source_row").select("source_row", error).limit(shown + 1).collect()
    if bad:
        raise TableError("; ".join(f"row {r[0]}: {r[1]}" for r in bad[:shown]) + (" ..." if len(bad) > shown else ""))


def checked_structures(df: DataFrame, columns: list[str], marker: str = "Hg", connected: bool = True, unrooted: list[str] | None = None) -> DataFrame:
    """``df`` if every structure is sound: those of ``columns`` hold one marker, and all of these and of ``unrooted`` can be read.

    Only distinct texts are examined; an error names the first row of each.
    """
    from rootgraph.functions.smiles import read_graphs

    long = df.unpivot("source_row", [*columns, *(unrooted or [])], "column", "s").withColumn("rooted", F.col("column").isin(*columns))
    long = read_graphs(long.groupBy("s", "rooted").agg(F.min("source_row").alias("source_row")), "s", None)
    wrong = F.when(F.col("rooted"), marker_error(F.col("s"), marker, connected)).otherwise(F.when(blank("s"), F.lit("empty")))
    report(long.select("source_row", F.coalesce(wrong, F.col("error")).alias("error")), "error")
    return df


def surrogate(ordinal: Column, prefix: str, width: int) -> Column:
    """prefix_000n."""
    return F.concat(F.lit(f"{prefix}_"), F.when(F.length(ordinal.cast("string")) >= width, ordinal.cast("string")).otherwise(F.lpad(ordinal.cast("string"), width, "0")))


def load_retention(spark: SparkSession, path: str | DataFrame, products: list[str] | None = None, marker: str = "Hg") -> tuple[DataFrame, list[str]]:
    """Building blocks with numbered product columns; adds bb_id."""
    df = path if isinstance(path, DataFrame) else read_csv(spark, path)
    names = [c for c in df.columns if c != "source_row"]
    required_columns(names, ["SMILES_BB"])
    products = products or numbered_columns(names)
    required_columns(names, products)
    if extra := [c for c in names if c not in ("SMILES_BB", *products)]:
        raise TableError(f"unexpected columns: {extra}")
    checked_structures(unique(not_empty(df), ["SMILES_BB"]), ["SMILES_BB", *products], marker)
    return df.withColumn("bb_id", surrogate(F.col("source_row") - 1, "BB", max(4, len(str(df.count()))))), products


def load_library(spark: SparkSession, path: str | DataFrame, marker: str = "Hg") -> DataFrame:
    """A complete two-component library; adds product_id."""
    wanted = ["BB1", "BB2", "SMILES_Product", "SMILES_BB1", "SMILES_BB2"]
    df = path if isinstance(path, DataFrame) else read_csv(spark, path)
    exact_columns([c for c in df.columns if c != "source_row"], wanted)
    counts = blank_counts(not_empty(df), wanted).first()
    if any(counts[f"{c}_blank"] for c in wanted):
        raise TableError(f"blank values: {counts.asDict()}")
    unique(df, ["BB1", "BB2"])
    component_table(df, "BB1", "SMILES_BB1")
    component_table(df, "BB2", "SMILES_BB2")
    if not cartesian(df, "BB1", "BB2").first()["complete"]:
        raise TableError("not every combination of BB1 and BB2 is there")
    checked_structures(df, wanted[2:], marker)
    return df.withColumn("product_id", surrogate(F.col("source_row") - 1, "P", 6))


def load_scaffolds(spark: SparkSession, path: str | DataFrame, marker: str = "Hg") -> DataFrame:
    """Scaffold, position and structure; trims, drops blank rows, adds molecule_id and canonical texts."""
    from rootgraph.functions.smiles import canonical

    wanted = ["Position", "SMILES_Structure", "SMILES_Scaffold"]
    df = path if isinstance(path, DataFrame) else read_csv(spark, path)
    required_columns(df.columns, wanted)
    df = not_empty(drop_blank_rows(df.select(*wanted, "source_row"), wanted))
    checked_structures(df, ["SMILES_Structure"], marker, unrooted=["SMILES_Scaffold"])
    df = ordinal(df, ["source_row"], "at").withColumn("molecule_id", surrogate(F.col("at"), "HET", 4)).drop("at")
    return df.withColumns({"canonical_structure": canonical("SMILES_Structure"), "canonical_scaffold": canonical("SMILES_Scaffold")})


def load_matched(spark: SparkSession, path: str | DataFrame, columns: tuple[str, ...], marker: str = "Hg") -> DataFrame:
    """An id, two unrooted and two rooted structures (``columns`` in this order). NA and blank are missing; ids stay text."""
    wanted = list(columns)
    df = path if isinstance(path, DataFrame) else read_csv(spark, path)
    required_columns(df.columns, wanted)
    df = df.select(*wanted, "source_row").withColumns({c: F.when(~F.trim(c).isin("", "NA", "NaN", "nan", "null"), F.col(c)) for c in wanted})
    counts = blank_counts(not_empty(df), wanted).first()
    if any(counts[f"{c}_blank"] for c in wanted):
        raise TableError(f"missing values: {counts.asDict()}")
    unique(df, [wanted[0]])
    return checked_structures(df, wanted[3:], marker, connected=False, unrooted=wanted[1:3])


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _occupied(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and len(files.listStatus(path)) > 0


def unused_directory(spark: SparkSession, base: str) -> str:
    """base, or base_2, base_3, ...: the first that is not in use."""
    k, name = 1, base
    while _occupied(spark, name):
        k += 1
        name = f"{base}_{k}"
    return name


def save(spark: SparkSession, results: dict[str, DataFrame], directory: str, metadata: dict | None = None, overwrite: bool = False, kind: str = "csv", partitions: dict[str, list[str]] | None = None) -> None:
    """Writes each table under its name and the metadata as JSON with sorted keys; a directory in use is refused unless ``overwrite``."""
    if not overwrite and _occupied(spark, directory):
        raise FileExistsError(f"{directory} is not empty")
    for name, df in results.items():
        out = df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, []))
        out.option("header", True).csv(f"{directory}/{name}") if kind == "csv" else out.parquet(f"{directory}/{name}")
    if metadata is not None:
        line = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{directory}/run_metadata")


def save_matrix(pairs: DataFrame, rows: DataFrame, path: str, size: int, key: str = "id") -> int:
    """Writes the upper triangle (i, j, values...) of a symmetric table as blocks of ``size`` rows and columns.

    ``rows`` lists the key and its place ``at``, from 0 without a gap. Block (p, q), p <= q, has a folder of its own, so a
    reader of a block touches no other; each is written by tasks of its own. Returns the number of blocks on a side.
    """
    if size < 1:
        raise ValueError("size must be positive")
    side = -(-rows.count() // size)
    at = lambda s: rows.select(F.col(key).alias(s), F.col("at").alias(f"at_{s}"))
    placed = pairs.join(at("i"), "i").join(at("j"), "j")
    low, high = F.least("at_i", "at_j"), F.greatest("at_i", "at_j")
    swap = F.col("at_i") > F.col("at_j")
    values = [c for c in pairs.columns if c not in ("i", "j")]
    placed = placed.select(F.when(swap, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("j"), *values, low.alias("row"), high.alias("column"), F.floor(low / size).cast("int").alias("p"), F.floor(high / size).cast("int").alias("q"))
    placed.repartition("p", "q").sortWithinPartitions("p", "q", "row", "column").write.mode("overwrite").partitionBy("p", "q").parquet(path)
    return side


def read_matrix(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, size: int = 1) -> DataFrame:
    """The stored triangle (i, j, values..., row, column, p, q), or the part of it that the ranges of places [from, to) of
    rows and columns cover, read from the blocks of ``size`` that these ranges meet."""
    out = spark.read.parquet(path)
    for name, block, between in (("row", "p", rows), ("column", "q", columns)):
        if between:
            low, high = between
            out = out.where(F.col(block).between(low // size, (high - 1) // size) & (F.col(name) >= low) & (F.col(name) < high))
    return out
