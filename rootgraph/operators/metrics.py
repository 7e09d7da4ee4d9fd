"""Agreement between similarity tables, and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootgraph.operators.quantiles import FEW, average_ranks, quantiles, summary
from rootgraph.sources.shared import stored, with_small

#: differences up to this count as none where a tolerance is asked for
TOLERANCE = 1e-12


def agreement(rows: DataFrame, x: str, y: str, group: list[str], few: int = FEW, weight: str | None = None) -> DataFrame:
    """(group..., n_pairs, spearman, pearson) of two columns; a correlation is null if either side is constant.

    Each row stands for one pair, or as many as ``weight`` says. Where no group has more than ``few`` different pairs, ranks
    come from windows.

    Equal pairs of values are counted first, and only these counts are ranked and summed, about the means. A value that
    very many pairs share is then as many rows as it has partners, and ranks are joined to salted keys or broadcast
    when few. Pairs with a null are left out; groups hold no nulls.
    """
    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("_x"), F.col(y).alias("_y"), (F.col(weight) if weight else F.lit(1)).alias("n"))
    seen = stored(seen.groupBy(*group, "_x", "_y").agg(F.sum("n").alias("n")), "pairs")
    n = F.col("n")
    means = seen.groupBy(*group).agg(F.sum("n").alias("_all"), (F.sum(F.col("_x") * n) / F.sum("n")).alias("_mx"), (F.sum(F.col("_y") * n) / F.sum("n")).alias("_my"))
    ranked = seen
    small = (seen.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= few
    for v, r in (("_x", "_rx"), ("_y", "_ry")):
        if small:
            upto, ties = Window.partitionBy(*group).orderBy(v), Window.partitionBy(*group, v)
            ranked = ranked.withColumn(r, F.sum("n").over(upto) - (F.sum("n").over(ties) - 1) / 2)
        else:
            ranked = with_small(ranked, average_ranks(seen, v, group, r, few), [*group, v])
    if small:
        whole, mean = Window.partitionBy(*group), lambda v: F.sum(F.col(v) * n).over(whole) / F.sum("n").over(whole)
        ranked = ranked.withColumns({"_all": F.sum("n").over(whole), "_mx": mean("_x"), "_my": mean("_y")})
    else:
        ranked = with_small(ranked, means, group)
    middle = (F.col("_all") + 1) / 2
    off = {"_dx": F.col("_x") - F.col("_mx"), "_dy": F.col("_y") - F.col("_my"), "_ex": F.col("_rx") - middle, "_ey": F.col("_ry") - middle}
    cross = lambda a, b: F.sum(F.col(a) * F.col(b) * n)
    varied = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    r = lambda a, b: F.when(varied, cross(a, b) / F.nullif(F.sqrt(cross(a, a)) * F.sqrt(cross(b, b)), F.lit(0.0)))
    return ranked.withColumns(off).groupBy(*group).agg(F.sum("n").alias("n_pairs"), r("_ex", "_ey").alias("spearman"), r("_dx", "_dy").alias("pearson"))


def errors(actual: Column, predicted: Column) -> dict[str, Column]:
    """Mean absolute and root mean square error as aggregates."""
    residual = actual - predicted
    return {"mae": F.avg(F.abs(residual)), "rmse": F.sqrt(F.avg(residual * residual))}


def spread(values: list[str], single: float | None = 0.0) -> list[Column]:
    """mean, std, min, max of each column; the std of one row is ``single``."""
    out = []
    for v in values:
        std = F.stddev_samp(v)
        out += [F.avg(v).alias(f"{v}_mean"), (std if single is None else F.coalesce(std, F.lit(single))).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return out


def effect_size(v: str) -> Column:
    """Mean over sample standard deviation, null where that is 0 or undefined."""
    return F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0))


def deltas(rows: DataFrame, level: str, reference: str, keys: list[str], values: list[str]) -> DataFrame:
    """(level, reference_<level>, keys..., delta_<value>...) of every other level against the reference level."""
    base = rows.where(F.col(level) == reference).select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    joined = rows.where(F.col(level) != reference).join(base, keys)
    return joined.select(level, F.lit(reference).alias(f"reference_{level}"), *keys, *((F.col(v) - F.col(f"_{v}")).alias(f"delta_{v}") for v in values))


def mean_deltas(differences: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """(group..., mean of each delta_<value>) of the rows of ``deltas``."""
    return differences.groupBy(*group).agg(*(F.avg(f"delta_{v}").alias(f"mean_delta_{v}") for v in values))


def describe(rows: DataFrame, columns: list[str], few: int = FEW) -> DataFrame:
    """(measure, count, mean, std, min, q25, median, q75, max) of each column."""
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "measure", "v")
    values = [F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    out = summary(long, ["measure"], values, {"q25": ("v", 0.25), "median": ("v", 0.5), "q75": ("v", 0.75)}, few, keep=True)
    return out.select("measure", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def batch_audit(manifest: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """How rows are spread over batches: ``describe`` of n_products and unique_products of a batch."""
    sizes = manifest.groupBy(batch).agg(F.count("*").alias("n_products"), F.count_distinct(key).alias("unique_products"))
    return describe(sizes, ["n_products", "unique_products"])


#: distances of a pair of ids by the kind of pair (fixed values)
PAIR_TYPES = {"within_1": "within the first", "within_2": "within the second", "cross_mean_distance": "across"}


def pair_types(controlled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., descriptor, pair_type, distance): the controlled distances of pairs as rows."""
    long = controlled.unpivot([*keys, "descriptor"], list(PAIR_TYPES), "pair_type", "distance")
    return long.withColumn("pair_type", F.coalesce(*(F.when(F.col("pair_type") == k, v) for k, v in PAIR_TYPES.items())))


def pair_type_summary(rows: DataFrame, few: int = FEW) -> DataFrame:
    """(descriptor, pair_type, n, mean, median, std) of ``pair_types``."""
    out = summary(rows, ["descriptor", "pair_type"], [F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std")], {"median": ("distance", 0.5)}, few)
    return out.select("descriptor", "pair_type", "n", "mean", "median", "std")


def pair_type_differences(rows: DataFrame, keys: list[str], reference: str, few: int = FEW) -> DataFrame:
    """(descriptor, pair_type, n, mean, median, std) of each descriptor's distance less that of the reference descriptor, for the same pair."""
    base = rows.where(F.col("descriptor") == reference).select(*keys, "pair_type", F.col("distance").alias("_base"))
    more = rows.where(F.col("descriptor") != reference).join(base, [*keys, "pair_type"]).withColumn("distance", F.col("distance") - F.col("_base"))
    return pair_type_summary(more.select("descriptor", "pair_type", "distance"), few)


def distances(rows: DataFrame, group: list[str], value: str, few: int = FEW) -> DataFrame:
    """n, mean, median, std and quartiles of a value for each group."""
    out = summary(rows, group, [F.count("*").alias("n_pairs"), F.avg(value).alias("mean_distance"), F.stddev_samp(value).alias("std_distance")], {"median_distance": (value, 0.5), "q25_distance": (value, 0.25), "q75_distance": (value, 0.75)}, few)
    return out.select(*group, "n_pairs", "mean_distance", "median_distance", "std_distance", "q25_distance", "q75_distance")


def separations(rows: DataFrame, group: list[str], few: int = FEW) -> DataFrame:
    """Summary of within_mean_distance, cross_mean_distance and topology_separation; positive means above 0, without tolerance."""
    s = "topology_separation"
    values = [
        F.count("*").alias("n_id_pairs"), F.avg("within_mean_distance").alias("mean_within_distance"), F.avg("cross_mean_distance").alias("mean_cross_distance"),
        F.avg(s).alias(f"mean_{s}"), F.stddev_samp(s).alias(f"std_{s}"), F.avg((F.col(s) > 0).cast("double")).alias("fraction_positive"), effect_size(s).alias("paired_effect_size"),
    ]
    out = summary(rows, group, values, {f"median_{s}": (s, 0.5)}, few)
    return out.select(*group, "n_id_pairs", "mean_within_distance", "mean_cross_distance", f"mean_{s}", f"median_{s}", f"std_{s}", "fraction_positive", "paired_effect_size")


def group_summary(pairs: DataFrame, descriptors: list[str], reference: str, suffix: str = "_distance", few: int = FEW, weight: str | None = None) -> DataFrame:
    """Distances of classified pairs by group and descriptor, and their difference from the reference descriptor.

    The reference's own rows have difference 0 and no fraction of pairs that are further apart. Equal rows are counted
    first; each stands for one pair, or as many as ``weight`` says.
    """
    kept = pairs.select("pair_group", "cluster_id", F.col(f"{reference}{suffix}").alias("_ref"), *(F.col(f"{d}{suffix}").alias(d) for d in descriptors), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    long = kept.unpivot(["pair_group", "cluster_id", "_ref", "n"], descriptors, "descriptor", "d").withColumn("delta", F.col("d") - F.col("_ref"))
    group = ["pair_group", "descriptor"]
    clusters = long.groupBy(*group).agg(F.count_distinct("cluster_id").alias("n_clusters"))
    long = stored(long.groupBy(*group, "d", "delta").agg(F.sum("n").alias("n")), "rows")
    n, total = F.col("n"), lambda v, m: F.sum(F.when(v.isNotNull(), m))
    mean = lambda v, m: F.sum(v * m) / total(v, m)
    d, delta = F.col("d"), F.col("delta")
    means = long.groupBy(*group).agg(mean(d, n).alias("mean_distance"), mean(delta, n).alias("mean_difference"))
    held = with_small(long, means, group)
    std = lambda v, m: F.sqrt(F.sum(F.pow(v - m, 2) * n) / F.nullif(total(v, n) - 1, F.lit(0)))
    sums = held.groupBy(*group, "mean_distance", "mean_difference").agg(F.sum("n").alias("n_pairs"), std(d, F.col("mean_distance")).alias("std_distance"), std(delta, F.col("mean_difference")).alias("std_difference"), mean((delta > TOLERANCE).cast("double"), n).alias("_f"))
    middle = quantiles(long, group, {"median_distance": ("d", 0.5), "median_difference": ("delta", 0.5)}, few, weight="n")
    out = sums.join(clusters, group).join(middle, group)
    more = F.when(F.col("descriptor") != reference, F.col("_f")).alias("fraction_more_dissimilar")
    return out.select("pair_group", "descriptor", "n_pairs", "n_clusters", "mean_distance", "median_distance", "std_distance", "mean_difference", "median_difference", "std_difference", more)


def bit_density(rows: DataFrame, group: list[str], bits: str, n_bits: int, few: int = FEW) -> DataFrame:
    rows = rows.select(*group, F.size(bits).alias("_n"))
    values = [F.count("*").alias("n_structures"), F.avg("_n").alias("mean_on_bits"), F.stddev_samp("_n").alias("std_on_bits"), F.avg(F.col("_n") / n_bits).alias("mean_bit_density"), F.stddev_samp(F.col("_n") / n_bits).alias("std_bit_density")]
    out = summary(rows, group, values, {"median_on_bits": ("_n", 0.5)}, few)
    return out.select(*group, "n_structures", "mean_on_bits", "median_on_bits", "std_on_bits", "mean_bit_density", "std_bit_density")
