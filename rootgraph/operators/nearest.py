"""Nearest neighbours under Tanimoto similarity from an index by bit counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from rootgraph.functions.blocks import nearest as np_nearest
from rootgraph.functions.blocks import words as words_of
from rootgraph.sources.shared import stored, with_small

#: cells of the index at most, rows of the library that meet one query at once, and queries that meet one such block
CELLS, BLOCK, ASKED = 512, 1 << 19, 1 << 16


def _counts(words: Column, n_words: int, parts: int) -> list[Column]:
    """Bit counts of ``parts`` equal runs of bits; a run may be a part of a word."""
    if n_words % parts == 0:
        per = n_words // parts
        return [reduce(lambda x, y: x + y, (F.bit_count(words[w]) for w in range(p * per, (p + 1) * per))) for p in range(parts)]
    cut = 64 * n_words // parts
    if parts % n_words or 64 % cut:
        raise ValueError("bits do not part evenly")
    mask = F.lit((1 << cut) - 1)
    return [F.bit_count(F.call_function("shiftrightunsigned", words[p * cut // 64], F.lit(p * cut % 64)).bitwiseAND(mask)) for p in range(parts)]


def _width(rows: DataFrame, counts: list[str], bits: int, limit: int) -> int:
    """The least power of two by which bit counts are divided so that at most ``limit`` cells are in use."""
    widths = [1 << k for k in range(bits.bit_length() + 1)]
    seen = rows.select(*counts).distinct().agg(*(F.count_distinct(F.struct(*(F.floor(F.col(c) / w) for c in counts))).alias(str(w)) for w in widths)).first()
    return next(w for w in widths if seen[str(w)] <= limit)


def nearest(queries: DataFrame, library: DataFrame, key: str, words: str, n_words: int, k: int, group: list[str] | None = None, parts: int | None = None, cells: int = CELLS, block: int = BLOCK, first: int | None = None, compared: tuple[Observation, Observation] | None = None) -> DataFrame:
    """(group..., query, rank, match, similarity): the k rows of ``library`` nearest each row of ``queries``, ties by the smaller match.

    The library is dealt into cells by the bit counts of ``parts`` runs of bits. Sums of the smaller and of the larger
    counts bound the similarity between cells. A query visits the cells of the highest bounds until they hold ``first``
    rows; its k-th best so far is a floor, and after that it visits only cells whose bound reaches it, so nothing is lost.
    Fingerprints of at most 64 bits in use are looked up by lanes of 16 bits first (``blocks.Best``), which finds the floor and
    mostly all that reach it. Of equal rows only those of the k + 1 smallest keys can be among the k, so no others are kept.
    The library is cut into blocks, queries into parts of neighbouring cells. A task compares one part with one block and
    returns the k best of each query, so pairs are never rows: what is shuffled are the rows of both sides, once for each
    block or part of the other, and k rows for each query and block.

    A row is not compared with itself (equal ``key`` in the same group); null keys and fingerprints match nothing. Groups
    hold no nulls. The pairs compared while a query had fewer than k, and after that, go to the two observations of
    ``compared``, under the name n.
    """
    group, parts = group or [], parts or (2 if n_words % 2 else min(n_words, 2))
    first = first or 16 * (k + 1)
    names = [f"_c{p}" for p in range(parts)]

    def celled(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull() & F.forall(words, lambda x: x.isNotNull())).select(*group, F.col(key).alias("_id"), F.col(words).alias("_words"))
        return rows.withColumns(dict(zip(names, _counts(F.col("_words"), n_words, parts), strict=True)))

    asked, held = celled(queries), celled(library)
    width = _width(held, names, 64 * n_words // parts, cells)
    asked, held = (r.withColumns({c: F.floor(F.col(c) / width).cast("int") for c in names}) for r in (asked, held))
    copy = Window.partitionBy(*group, "_words").orderBy("_id")
    held = held.withColumn("_copy", F.dense_rank().over(copy)).where(F.col("_copy") <= k + 1).drop("_copy")
    slots = asked.sparkSession.sparkContext.defaultParallelism
    part = min(ASKED, max(256, -(-asked.count() // (2 * slots))))

    # which parts hold the queries of a cell: a row a cell; how many parts and blocks a group has: a row a group
    at = asked.groupBy(*group, *names).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / part).cast("int")
    at = stored(at.withColumns({"_begin": begin, "_own": F.ceil(F.col("n") / part).cast("int")}).drop("n"), "cells")
    blocks = held.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    total = at.groupBy(*group).agg(F.max(F.col("_begin") + F.col("_own")).alias("_parts"))
    total = stored((blocks.join(total, group) if group else blocks.crossJoin(total)).where("_blocks > 0 and _parts > 0"), "blocks")
    n = total.agg(F.sum(F.col("_blocks") * F.col("_parts"))).first()[0] or 1
    deal = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
    asked = with_small(with_small(asked, at, [*group, *names]), total, group).withColumn("_part", F.col("_begin") + own("_own")).withColumn("_block", deal("_blocks"))
    held = with_small(held, total, group).withColumn("_block", own("_blocks")).withColumn("_part", deal("_parts"))
    on = [*group, "_part", "_block"]
    spread = min(2 * n, max(4096, 2 * slots))  # a number of its own, as few bytes here are much work
    asked = asked.select(*on, "_id", "_words", *names).repartition(spread, *on)
    held = held.select(*(F.col(c).alias(f"_h{c}") for c in on), "_id", "_words", *names).repartition(spread, *(f"_h{c}" for c in on))
    schema = StructType([*(asked.schema[g] for g in group), StructField("query", asked.schema["_id"].dataType), StructField("match", held.schema["_id"].dataType), StructField("similarity", DoubleType()), StructField("_early", LongType()), StructField("_late", LongType())])
    types = {f.name: f for f in to_arrow_schema(schema)}

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        place = lambda t: np.stack([t[c].to_numpy() for c in names], axis=1)
        ids = b["_id"].to_numpy()
        found, n_pairs = np_nearest(a["_id"].to_numpy(), words_of(a["_words"], n_words), place(a), ids, words_of(b["_words"], n_words), place(b), width, k, first) if len(a) and len(b) else ([], [0, 0])
        row, col, s = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        row, col = (pa.array(np.r_[x, 0], mask=np.r_[np.zeros(len(x), bool), True]) for x in (row, col))  # the last row is that of the counts
        values = {"query": a["_id"].combine_chunks().take(row), "match": b["_id"].combine_chunks().take(col), "similarity": pa.array(np.r_[s, 0.0]), "_early": pa.array(np.r_[np.zeros(len(s), np.int64), n_pairs[0]]), "_late": pa.array(np.r_[np.zeros(len(s), np.int64), n_pairs[1]])}
        values |= {g: pa.array([(a[g] if len(a) else b[f"_h{g}"])[0].as_py()] * len(row), type=types[g].type) for g in group}
        return pa.table({f.name: values[f.name].cast(f.type) for f in types.values()})

    found = asked.groupBy(*on).cogroup(held.groupBy(*(f"_h{c}" for c in on))).applyInArrow(compare, schema)
    for seen, c in zip(compared or (), ("_early", "_late"), strict=False):
        found = found.observe(seen, F.sum(c).alias("n"))
    best = Window.partitionBy(*group, "query").orderBy(F.col("similarity").desc(), "match")
    found = found.where("query is not null").drop("_early", "_late").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select(*group, "query", "rank", "match", "similarity")
