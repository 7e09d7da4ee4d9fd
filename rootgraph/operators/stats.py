"""Resampling, batching, densities, histograms, mixtures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootgraph.operators.metrics import TOLERANCE
from rootgraph.operators.quantiles import FEW, cell, chosen, cutting, inside, quantiles, running, summary
from rootgraph.sources.shared import stored, with_small


def ordinal(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds the 0-based rank in a total order. Ranks come from counts of range-sorted partitions, so no task sees all rows."""
    at = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_row", 33)
    per = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_row").alias("_lo"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"))
    return with_small(at.withColumn("_part", part), shift, ["_part"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def batches(rows: DataFrame, batch_size: int, order: list[Column | str], name: str = "batch") -> DataFrame:
    """Adds a 0-based batch number and within_batch_order: ceil(n / batch_size) batches whose sizes differ by one at most.

    ``order`` decides who goes where; ordering by a hash of seed and id gives a reproducible permutation.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    n = rows.count()
    k = max(1, -(-n // batch_size))
    small, extra = divmod(n, k)
    edge = extra * (small + 1)
    at = F.col("_at")
    batch = F.when(at < edge, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - edge) / max(1, small))).cast("int")
    within = F.when(at < edge, at % (small + 1)).otherwise((at - edge) % max(1, small)).cast("int")
    return ordinal(rows, order, "_at").withColumns({name: batch, "within_batch_order": within}).drop("_at")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: DataFrame, group: list[str], few: int = FEW, exact: int = 256, weight: str | None = None) -> DataFrame:
    """Bootstrap over clusters: (group..., statistic, estimate, standard_error, ci_95_lower, ci_95_upper, n_replicates).

    ``draws`` lists (group..., replicate, slot, ordinal): which cluster (0-based, by name) each slot of a replicate
    takes. All values of a drawn cluster enter, as often as it is drawn. Mean and median are taken for each replicate:
    the mean from sums of clusters, the median by selection over histograms of clusters. Rows are not repeated for
    replicates: what meets them is a cell count for each cluster, and at last the values of the cells in which medians lie,
    at most ``exact`` in each. A row counts once, or as often as ``weight`` says. Groups hold no nulls; null values do not count.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*group, cluster, F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    names = running(rows.select(*group, cluster).distinct(), group, [cluster], F.lit(1), "ordinal", few)
    counts = rows.groupBy(*group, cluster, "v").agg(F.sum("n").alias("n"))  # equal values of a cluster travel once
    counts = stored(with_small(counts, names, [*group, cluster]).drop(cluster), "histograms")
    times = stored(draws.groupBy(*group, "replicate", "ordinal").agg(F.count("*").alias("times")), "times")
    on, drawn = [*group, "ordinal"], F.col("n") * F.col("times")
    sums = counts.groupBy(*on).agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    per = times.join(sums, on).groupBy(*group, "replicate").agg((F.sum(F.col("s") * F.col("times")) / F.sum(drawn)).alias("mean"), F.sum(drawn).alias("n_in"))
    per = stored(per, "means")

    bracket, known, empty = F.xxhash64("low", "high"), F.col("value").isNotNull(), F.lit(None).cast("double")
    ranks = per.select(*group, "replicate", "n_in", F.explode(F.array_distinct(F.array(F.floor((F.col("n_in") - 1) / 2), F.floor(F.col("n_in") / 2)))).alias("rank"))
    state = stored(ranks.select(*group, "replicate", "rank", F.lit(0).cast("long").alias("below"), "n_in", empty.alias("low"), empty.alias("high"), empty.alias("value")), "medians")
    keys = [*group, "replicate", "bracket"]
    while True:
        open_ = state.where(~known).withColumn("bracket", bracket)
        ranges = stored(open_.select(*group, "bracket", "low", "high").distinct(), "brackets")
        held = with_small(counts, ranges, group).where(inside(F.col("v"))).drop("low", "high")
        wide = held.groupBy(*group, "bracket").agg(F.count_distinct("v").alias("d")).where(F.col("d") > exact).select(*group, "bracket")
        wide = stored(wide, "wide")
        if not wide.limit(1).count():
            break
        held = held.join(wide, [*group, "bracket"])
        pivots = stored(held.groupBy(*group, "bracket").agg(cutting(F.col("v")).alias("pivots")), "pivots")
        cells = with_small(held, pivots, [*group, "bracket"]).groupBy(*on, "bracket", cell(F.col("v"), F.col("pivots")).alias("cell")).agg(F.sum("n").alias("n"))
        large = open_.join(wide, [*group, "bracket"])
        met = cells.join(times.join(large.select(*keys).distinct(), [*group, "replicate"]), [*on, "bracket"]).groupBy(*keys, "cell").agg(F.sum(drawn).alias("n"))
        found = chosen(met.join(pivots, [*group, "bracket"]), large, keys).select(*state.columns)
        rest = state.withColumn("bracket", bracket).join(wide.withColumn("_wide", F.lit(True)), [*group, "bracket"], "left").where(known | F.col("_wide").isNull()).select(*state.columns)
        state = stored(rest.unionByName(found), "medians")
    last = held.join(times.join(open_.select(*keys).distinct(), [*group, "replicate"]), [*on, "bracket"]).groupBy(*keys, "v").agg(F.sum(drawn).alias("n"))
    before = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # at most ``exact`` rows
    last = open_.drop("value").join(last.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), keys)
    start = F.col("below") + F.col("_before")
    last = last.where((F.col("rank") >= start) & (F.col("rank") < start + F.col("n"))).select(*group, "replicate", F.col("v").alias("value"))
    medians = state.where(known).select(*group, "replicate", "value").unionByName(last).groupBy(*group, "replicate").agg(F.avg("value").alias("median"))

    per = per.join(medians, [*group, "replicate"])
    seen = counts.groupBy(*group, "v").agg(F.sum("n").alias("n"))
    seen = seen.groupBy(*group).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).join(quantiles(seen, group, {"median": ("v", 0.5)}, few, weight="n"), group).unpivot(group, ["mean", "median"], "statistic", "estimate")
    long = per.unpivot([*group, "replicate"], ["mean", "median"], "statistic", "x")
    found = long.groupBy(*group, "statistic").agg(F.stddev_samp("x").alias("standard_error"), F.percentile("x", 0.025).alias("ci_95_lower"), F.percentile("x", 0.975).alias("ci_95_upper"), F.count("*").alias("n_replicates"))  # a value a replicate
    return seen.join(found, [*group, "statistic"])


def hashed_draws(clusters: DataFrame, group: list[str], replicates: int, seed: Column | int) -> DataFrame:
    """Draws for ``cluster_bootstrap`` from a SHA-256 of seed, group, replicate and slot; ``clusters`` has (group..., n)."""
    slots = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws("|", seed.cast("string"), *(F.col(g).cast("string") for g in group), F.col("replicate").cast("string"), F.col("slot").cast("string"))
    return slots.select(*group, "replicate", "slot", (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % F.col("n")).alias("ordinal"))


def kde(values: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(x, density) of a Gaussian kernel estimate with Scott's bandwidth on a grid (a config-sized list).

    One pass over the values: each partial aggregate holds one sum a grid point.
    """
    stats = values.agg(F.count(value), F.stddev_samp(value)).first()
    n, width = stats[0], (stats[1] or 0.0) * max(1, stats[0]) ** -0.2
    if not n or not width:
        raise ValueError("a density needs values that differ")
    kernel = lambda x: F.sum(F.exp(-F.pow((F.lit(x) - F.col(value)) / width, 2) / 2))
    sums = values.agg(F.array(*(kernel(x) for x in grid)).alias("d"))
    return sums.select(F.posexplode("d").alias("k", "s")).select(F.array(*map(F.lit, grid))[F.col("k")].alias("x"), (F.col("s") / (n * width * math.sqrt(2 * math.pi))).alias("density"))


def kde_2d(values: DataFrame, x: str, y: str, grid_x: list[float], grid_y: list[float], bins: int | None = None) -> DataFrame:
    """(x, y, density) of a product-kernel estimate with Scott's bandwidths on a grid (lists of a config's size).

    With ``bins`` values are first shared out to the nodes of a lattice of bins by bins over their range, each to the four
    around it in proportion to nearness, by four sums a cell. The kernel then runs over nodes, along one axis and then the
    other, so that rows are read once and never meet the grid. Moving weight to nodes d apart changes the density by at
    most dx^2 / (8 hx^2) + dy^2 / (8 hy^2) of the kernel's peak, 1 / (2 pi hx hy). Without, every row meets every grid point.
    Values differ in both columns; rows with a null do not count.
    """
    values = values.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = values.agg(F.count("*"), F.stddev_samp(x), F.stddev_samp(y), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if not r[1] or not r[2]:
        raise ValueError("a density needs values that differ")
    hx, hy = (s * r[0] ** (-1 / 6) for s in (r[1], r[2]))
    spark = values.sparkSession
    if bins is None:
        grid = spark.createDataFrame([(a, b) for a in grid_x for b in grid_y], "gx double, gy double")
        term = F.exp(-(F.pow((F.col("gx") - F.col(x)) / hx, 2) + F.pow((F.col("gy") - F.col(y)) / hy, 2)) / 2)
        return values.select(x, y).join(F.broadcast(grid)).groupBy("gx", "gy").agg((F.sum(term) / (r[0] * hx * hy * 2 * math.pi)).alias("density")).toDF("x", "y", "density")
    if bins < 2:
        raise ValueError("a lattice has at least two nodes a side")
    (x0, dx), (y0, dy) = ((low, (high - low) / (bins - 1)) for low, high in ((r[3], r[4]), (r[5], r[6])))
    place = lambda c, low, d: F.least(F.floor((F.col(c) - low) / d), F.lit(bins - 2)).cast("int")
    off = lambda c, low, d: (F.col(c) - low) / d - place(c, low, d)
    fx, fy = off(x, x0, dx), off(y, y0, dy)
    cells = values.groupBy(place(x, x0, dx).alias("i"), place(y, y0, dy).alias("j")).agg(F.count("*").alias("n"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fy).alias("sxy"))
    n, sx, sy, sxy = map(F.col, ("n", "sx", "sy", "sxy"))
    share = lambda a, b, w: F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), w.alias("w"))
    nodes = cells.select(F.explode(F.array(share(0, 0, n - sx - sy + sxy), share(1, 0, sx - sxy), share(0, 1, sy - sxy), share(1, 1, sxy))).alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.w").alias("w"))
    along = lambda grid: F.explode(F.array(*map(F.lit, grid)))
    kernel = lambda g, at, low, d, h: F.exp(-F.pow((F.col(g) - (low + F.col(at) * d)) / h, 2) / 2)
    rows = nodes.withColumn("gx", along(grid_x)).groupBy("gx", "j").agg(F.sum(F.col("w") * kernel("gx", "i", x0, dx, hx)).alias("w"))
    out = rows.withColumn("gy", along(grid_y)).groupBy("gx", "gy").agg((F.sum(F.col("w") * kernel("gy", "j", y0, dy, hy)) / (r[0] * hx * hy * 2 * math.pi)).alias("density"))
    return out.toDF("x", "y", "density")


def density_levels(density: DataFrame, masses: list[float]) -> DataFrame:
    """(mass, threshold): the density of the cell at which the densest cells first hold the mass."""
    spark = density.sparkSession
    cum = Window.orderBy(F.col("density").desc(), "x", "y").rowsBetween(Window.unboundedPreceding, 0)  # grid-sized
    share = density.withColumn("held", F.sum("density").over(cum)).withColumn("total", F.sum("density").over(Window.partitionBy()))
    wanted = spark.createDataFrame([(float(m),) for m in masses], "mass double")
    return share.join(F.broadcast(wanted), F.col("held") >= F.col("mass") * F.col("total")).groupBy("mass").agg(F.max("density").alias("threshold"))


def histogram_fd(values: DataFrame, value: str, few: int = FEW) -> DataFrame:
    """(bin, lower, upper, count) with the Freedman-Diaconis bin width."""
    r = summary(values, [], [F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")], {"q1": (value, 0.25), "q3": (value, 0.75)}, few).first()
    n, low, high, q1, q3 = r.n, r.low, r.high, r.q1, r.q3
    width = 2 * (q3 - q1) / n ** (1 / 3) if n else 0
    k = max(1, math.ceil((high - low) / width)) if width else 1
    step = (high - low) / k if n and high > low else 1.0
    place = F.least(F.floor((F.col(value) - (low or 0.0)) / step), F.lit(k - 1)).cast("int")
    return values.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("count")).select("bin", (F.col("bin") * step + (low or 0.0)).alias("lower"), ((F.col("bin") + 1) * step + (low or 0.0)).alias("upper"), "count")


def hexbin(values: DataFrame, x: str, y: str, gridsize: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(hx, hy, half, count) of hexagonal cells over a box; ``half`` tells the two interleaved lattices apart."""
    x0, x1, y0, y1 = box
    ny = int(gridsize / math.sqrt(3))
    u, v = (F.col(x) - x0) / (x1 - x0) * gridsize, (F.col(y) - y0) / (y1 - y0) * ny
    i1, j1, i2, j2 = F.floor(u + 0.5), F.floor(v + 0.5), F.floor(u), F.floor(v)
    d1 = F.pow(u - i1, 2) + 3 * F.pow(v - j1, 2)
    d2 = F.pow(u - i2 - 0.5, 2) + 3 * F.pow(v - j2 - 0.5, 2)
    cell = values.select(F.when(d1 < d2, i1).otherwise(i2).alias("hx"), F.when(d1 < d2, j1).otherwise(j2).alias("hy"), F.when(d1 < d2, 0).otherwise(1).alias("half"))
    return cell.groupBy("hx", "hy", "half").agg(F.count("*").alias("count"))


def boxplot(values: DataFrame, group: list[str], value: str, few: int = FEW) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and how many values lie beyond. Groups hold no nulls."""
    q = quantiles(values, group, {"q25": (value, 0.25), "median": (value, 0.5), "q75": (value, 0.75)}, few)
    at = with_small(values, q, group)  # one row a group
    low, high = F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(low, high)
    return at.groupBy(*group, "q25", "median", "q75").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def matched_report(deltas: DataFrame, value: str, few: int = FEW) -> DataFrame:
    """(metric, value): the report of matched differences, with a tolerance around 0."""
    v = F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    found = {
        "n_pairs": F.count("*"), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v),
        "fraction_greater": share(v > TOLERANCE), "fraction_equal": share(F.abs(v) <= TOLERANCE), "fraction_less": share(v < -TOLERANCE),
    }
    wanted = {"median": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)}
    out = summary(deltas, [], [c.cast("double").alias(k) for k, c in found.items()], wanted, few)
    return out.unpivot([], [*found, *wanted], "metric", "value")
