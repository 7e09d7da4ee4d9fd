"""Exact quantiles, running sums and average ranks of groups of any size; no task holds a large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootgraph.sources.shared import stored, with_small

#: values of one group that a task may hold at once
FEW = 100_000
#: values that cut a range into cells in one round
PIVOTS = 31


def cell(value: Column, pivots: Column, n: int = PIVOTS) -> Column:
    """Which part of a line cut at ascending, different pivots a value lies in: 2c between pivots c - 1 and c, 2c + 1 on pivot c."""
    below = reduce(lambda a, b: a + b, (F.coalesce((value > F.get(pivots, F.lit(i))).cast("int"), F.lit(0)) for i in range(n)))
    on = F.array_contains(pivots, value).cast("int")
    return 2 * below + on


def cutting(value: Column, n: int = PIVOTS) -> Column:
    """Aggregate: ascending, different values that cut a range into about equal parts, all of them values of the range."""
    found = F.percentile_approx(value, [(i + 1) / (n + 1) for i in range(n)], 1000)
    return F.array_sort(F.array_distinct(found))


def inside(value: Column) -> Column:
    """Whether a value lies in the open range of the columns low and high, null being no bound."""
    return F.coalesce(value > F.col("low"), F.lit(True)) & F.coalesce(value < F.col("high"), F.lit(True))


def chosen(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets (keys, rank, below, low, high, ...) with the cell that holds their rank.

    ``counts`` has n for each (keys, cell), and pivots; its keys have as many rows as there are cells. A rank that falls on
    a pivot gets ``value``; of any other, below, low, high and n_in follow the cell.
    """
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = targets.drop("n_in").join(cum, keys).withColumn("_start", F.col("below") + F.col("_before"))
    hit = hit.where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("n")))
    c = F.floor(F.col("cell") / 2).cast("int")
    return hit.withColumns(
        {
            "value": F.when(F.col("cell") % 2 == 1, F.get("pivots", c)),
            "low": F.coalesce(F.get("pivots", c - 1), F.col("low")),
            "high": F.coalesce(F.get("pivots", c), F.col("high")),
            "below": F.col("_start"),
            "n_in": F.col("n"),
        }
    ).drop("_before", "_start", "cell", "pivots", "n")


def ranks_of(n: Column, p: Column) -> dict[str, Column]:
    """0-based ranks between which a quantile of n values lies, and how far."""
    at = (n - 1) * p
    return {"first": F.floor(at), "second": F.least(F.floor(at) + 1, n - 1), "share": at - F.floor(at)}


def between(first: Column, second: Column, share: Column) -> Column:
    return F.when(first == second, first).otherwise((1 - share) * first + share * second)


def quantiles(rows: DataFrame, group: list[str], wanted: dict[str, tuple[str, float]], few: int = FEW, weight: str | None = None) -> DataFrame:
    """(group..., a column for each of ``wanted``): exact quantiles with linear interpolation, as those of ``percentile``.
    A row counts once, or as often as the whole number ``weight`` says.

    ``wanted`` maps names to (column, probability). Where no group holds more than ``few`` rows one aggregate does it.
    Otherwise each wanted rank is found by selection: a range of values that holds it is cut at approximate quantiles, the
    parts are counted, and the part with the rank is the next range, until it is a single value or holds few rows.
    Nulls do not count; NaN is above all. Groups may be null. A group without values has nulls.
    """
    most = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= few:
        return rows.groupBy(*group).agg(*(F.percentile(v, p, F.col(weight) if weight else 1).alias(k) for k, (v, p) in wanted.items()))
    key = F.struct(*(F.col(g) for g in group)) if group else F.struct(F.lit(1).alias("one"))
    out = rows.select(key.alias("_g")).distinct()
    for column in sorted({v for v, _ in wanted.values()}):
        own = {k: p for k, (v, p) in wanted.items() if v == column}
        out = out.join(_selected(rows.where(F.col(column).isNotNull()).select(key.alias("_g"), F.col(column).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")), own, few), "_g", "left")
    return out.select(*(F.col("_g")[g].alias(g) for g in group), *wanted)


def _selected(values: DataFrame, wanted: dict[str, float], few: int) -> DataFrame:
    sizes = stored(values.groupBy("_g").agg(F.sum("_w").alias("n_in")), "sizes")
    asked = sizes.withColumn("q", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in wanted.items())))).select("_g", "n_in", "q.*")
    asked = asked.withColumns(ranks_of(F.col("n_in"), F.col("p")))
    empty = F.lit(None).cast("double")
    ranks = asked.select("_g", "n_in", F.explode(F.array("first", "second")).alias("rank")).distinct()
    state = stored(ranks.select("_g", "rank", F.lit(0).cast("long").alias("below"), "n_in", empty.alias("low"), empty.alias("high"), empty.alias("value")), "ranks")
    keys = ["_g", "bracket"]
    known = F.col("value").isNotNull()
    while state.where(~known & (F.col("n_in") > few)).limit(1).count():
        large = state.where(~known & (F.col("n_in") > few)).withColumn("bracket", F.col("below"))
        ranges = large.select("_g", "bracket", "low", "high").distinct()
        held = with_small(values, ranges, ["_g"]).where(inside(F.col("_v"))).select("_g", "bracket", "_v")
        pivots = stored(held.groupBy(*keys).agg(cutting(F.col("_v")).alias("pivots")), "pivots")
        counts = with_small(values, ranges.join(pivots, keys), ["_g"]).where(inside(F.col("_v"))).withColumn("cell", cell(F.col("_v"), F.col("pivots")))
        counts = counts.groupBy(*keys, "cell").agg(F.sum("_w").alias("n"), F.any_value("pivots").alias("pivots"))
        found = chosen(counts, large, keys).select(*state.columns)
        state = stored(state.where(known | (F.col("n_in") <= few)).unionByName(found), "ranks")
    ranges = state.where(~known).select("_g", F.col("below").alias("bracket"), "low", "high").distinct()
    held = with_small(values, ranges, ["_g"]).where(inside(F.col("_v"))).groupBy(*keys, "_v").agg(F.sum("_w").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # at most ``few`` rows
    held = held.withColumn("_start", F.col("bracket") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = state.where(~known).drop("value").withColumn("bracket", F.col("below")).join(held, keys)
    last = last.where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("n"))).select("_g", "rank", F.col("_v").alias("value"))
    at = stored(state.where(known).select("_g", "rank", "value").unionByName(last), "found")
    both = asked.join(at.toDF("_g", "first", "_a"), ["_g", "first"]).join(at.toDF("_g", "second", "_b"), ["_g", "second"])
    return both.groupBy("_g").agg(*(F.max(F.when(F.col("name") == k, between(F.col("_a"), F.col("_b"), F.col("share")))).alias(k) for k in wanted))


def summary(rows: DataFrame, group: list[str], values: list[Column], wanted: dict[str, tuple[str, float]], few: int = FEW, keep: bool = False) -> DataFrame:
    """(group..., aggregates ``values``, quantiles ``wanted``) of each group.

    One aggregate where no group holds more than ``few`` rows, else two results joined by group. ``keep`` stores the
    rows first, for those that cost more to make than to read.
    """
    rows = stored(rows, "rows") if keep else rows
    most = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= few:
        return rows.groupBy(*group).agg(*values, *(F.percentile(v, p).alias(k) for k, (v, p) in wanted.items()))
    a, b = rows.groupBy(*group).agg(*values), quantiles(rows, group, wanted, few)
    if not group:
        return a.crossJoin(b)
    b = b.withColumnsRenamed({g: f"_{g}" for g in group})
    on = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group))
    return a.join(b, on).drop(*(f"_{g}" for g in group))


def running(rows: DataFrame, group: list[str], order: list[str], weight: Column, name: str, few: int = FEW) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows before, in its group. Rows have different (group, order); groups hold no nulls.

    Up to ``few`` rows one window a group does it. Otherwise rows are range-sorted: a window runs within each range, and
    the sums of the ranges before, of which a group has as many as there are partitions, are added.
    """
    rows = stored(rows, "running")
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    if rows.count() <= few:
        return rows.withColumn(name, total(weight, upto(group, order)))
    ranged = stored(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*group, "_part").agg(F.sum(weight).alias("_w"))
    parts = parts.select(*group, "_part", total("_w", upto(group, ["_part"])).alias("_carry"))
    within = ranged.withColumn(name, total(weight, upto([*group, "_part"], order)))
    return with_small(within, parts, [*group, "_part"]).withColumn(name, F.col(name) + F.col("_carry")).drop("_part", "_carry")


def average_ranks(counts: DataFrame, value: str, group: list[str], name: str, few: int = FEW) -> DataFrame:
    """(group..., value, name) of (group..., value, n): the average rank of each value, ties sharing theirs."""
    each = counts.groupBy(*group, value).agg(F.sum("n").alias("_n"))
    before = running(each, group, [value], F.col("_n"), "_before", few)
    return before.select(*group, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
