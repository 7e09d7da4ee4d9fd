"""Gaussian mixtures of one value, fitted to sums that tasks send."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootgraph.operators.quantiles import FEW, summary
from rootgraph.sources.shared import stored

#: added to every variance, which keeps a component from shrinking onto one value
FLOOR = 1e-6
#: values from which starting means are drawn
SEEDS = 1000

#: weights, means and variances of the components of one model
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sums(x: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihood, then for each component the sums of responsibilities, of these times x, and times x squared."""
    w, m, v = model
    each = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
    top = each.max(axis=1)
    total = top + np.log(np.exp(each - top[:, None]).sum(axis=1))
    r = np.exp(each - total[:, None]) * n[:, None]
    return np.concatenate([[total @ n], r.sum(axis=0), x @ r, (x * x) @ r])


def _round(counts: DataFrame, models: dict[int, Model], mean: float, width: float) -> dict[int, np.ndarray]:
    """The sums of every model over all values: one aggregate, of a row for each model and number."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = (b.column(0).to_numpy(zero_copy_only=False) - mean) / width
            n = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            for i in range(0, len(x), 4096):
                for k, m in models.items():
                    total[k] = total.get(k, 0.0) + _sums(x[i : i + 4096], n[i : i + 4096], m)
        rows = [(k, j, float(v)) for k, s in total.items() for j, v in enumerate(s)]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["model", "j", "s"])

    out: dict[int, list] = {k: [0.0] * (1 + 3 * len(m[0])) for k, m in models.items()}
    for r in counts.mapInArrow(part, "model int, j int, s double").groupBy("model", "j").agg(F.sum("s").alias("s")).collect():
        out[r.model][r.j] = r.s
    return {k: np.array(s) for k, s in out.items()}


def _next(sums: np.ndarray, k: int, floor: float) -> Model:
    r = sums[1 : 1 + k] + 10 * np.finfo(float).eps
    m = sums[1 + k : 1 + 2 * k] / r
    return r / r.sum(), m, np.maximum(sums[1 + 2 * k :] / r - m * m, 0.0) + floor


def fit(counts: DataFrame, sizes: tuple[int, ...], starts: int, seed: int, rounds: int = 100, tolerance: float = 1e-4) -> dict[int, tuple[float, Model]]:
    """For each number of components the log-likelihood and the model of the best start; ``counts`` holds (value, n).

    All starts of all sizes go through expectation and maximisation together. A round is one pass over the distinct values
    and sends a few numbers for each model; a model leaves when its mean log-likelihood gains less than ``tolerance``.
    """
    v, n = F.col("value"), F.col("n")
    r = counts.agg(F.sum("n").alias("n"), (F.sum(v * n) / F.sum("n")).alias("mean")).first()
    if not r.n:
        raise ValueError("a mixture needs values")
    var = counts.agg((F.sum((v - r.mean) ** 2 * n) / r.n).alias("v")).first().v
    width = math.sqrt(var) or 1.0
    floor = FLOOR / width**2
    out: dict[int, tuple[float, Model]] = {}
    if 1 in sizes:  # a single Gaussian has a closed form
        like = -r.n / 2 * (math.log(2 * math.pi * (var + FLOOR)) + var / (var + FLOOR))
        out[1] = like, (np.ones(1), np.array([r.mean]), np.array([var + FLOOR]))
    sample = counts.orderBy(F.xxhash64(F.lit(seed), "value"), "value").limit(SEEDS).collect()
    draw, models, kinds = random.Random(seed), {}, {}
    for k in sorted(set(sizes) - {1}):
        for _ in range(starts):
            m = np.array(draw.choices([(x.value - r.mean) / width for x in sample], [x.n for x in sample], k=k))
            kinds[len(kinds)] = k
            models[len(models)] = np.full(k, 1 / k), m + 1e-6 * np.arange(k), np.full(k, 1 / k**2)
    live, last = dict(models), {}
    for _ in range(rounds):
        if not live:
            break
        sums = _round(counts, live, r.mean, width)
        for i in list(live):
            like = sums[i][0]
            if i in last and (like - last[i]) / r.n < tolerance:
                del live[i]
            else:
                live[i] = models[i] = _next(sums[i], kinds[i], floor)
            last[i] = like
    ends = _round(counts, models, r.mean, width) if models else {}
    for k in sorted(set(sizes) - {1}):
        best = max((i for i in models if kinds[i] == k), key=lambda i: ends[i][0])
        w, m, s = models[best]
        out[k] = float(ends[best][0] - r.n * math.log(width)), (w, r.mean + m * width, s * width**2)
    return out


def _densities(value: Column, model: Model) -> list[Column]:
    return [F.lit(math.log(w) - 0.5 * math.log(2 * math.pi * v)) - (value - float(m)) * (value - float(m)) / (2 * float(v)) for w, m, v in zip(*model, strict=True)]


def mixtures(values: DataFrame, key: str, value: str, counts: tuple[int, ...] = (1, 2, 3, 4), primary: int = 2, seed: int = 123, starts: int = 20, few: int = FEW) -> dict[str, DataFrame]:
    """Gaussian mixtures of one value: model_comparison, component_summary, assignments.

    The best of several seeded starts counts; components are numbered from 1 by rising mean. AIC and BIC use 3k - 1
    parameters. All values must be finite.
    """
    if not counts or min(counts) < 1 or primary not in counts:
        raise ValueError("component counts must be positive and hold the primary one")
    v = F.col(value)
    rows = stored(values.select(key, v.cast("double").alias(value)), "values")
    if rows.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).limit(1).count():
        raise ValueError("all values must be finite")
    distinct = stored(rows.groupBy(v.alias("value")).agg(F.count("*").alias("n")), "distinct")
    n, spark = rows.count(), values.sparkSession
    fitted = fit(distinct, tuple(counts), starts, seed)
    table = [(k, 2 * (3 * k - 1) - 2 * fitted[k][0], (3 * k - 1) * math.log(n) - 2 * fitted[k][0]) for k in sorted(fitted)]
    best = [min(t[i] for t in table) for i in (1, 2)]
    comparison = spark.createDataFrame([(*t, t[1] - best[0], t[2] - best[1]) for t in table], "n_components int, aic double, bic double, delta_aic double, delta_bic double")
    order = np.argsort(fitted[primary][1][1], kind="stable")
    model = tuple(x[order] for x in fitted[primary][1])
    each = _densities(v, model)
    top = F.greatest(*each) if primary > 1 else each[0]
    share = F.lit(0.0)
    for d in each:
        share = share + F.exp(d - top)
    assigned = rows.select(key, value, F.array_position(F.array(*each), top).cast("int").alias("component"), (1 / share).alias("assignment_probability"))
    shape = spark.createDataFrame([(i + 1, float(w), float(m), math.sqrt(s)) for i, (w, m, s) in enumerate(zip(*model, strict=True))], "component int, model_weight double, fitted_mean double, fitted_std double")
    seen = summary(assigned, ["component"], [F.count("*").alias("n_assigned"), F.avg(value).alias("assigned_mean"), F.stddev_samp(value).alias("assigned_std"), F.min(value).alias("assigned_min"), F.max(value).alias("assigned_max")], {"assigned_median": (value, 0.5)}, few)
    seen = seen.select("component", "n_assigned", "assigned_mean", "assigned_median", "assigned_std", "assigned_min", "assigned_max")
    parts = shape.join(F.broadcast(seen), "component", "left").withColumn("n_assigned", F.coalesce("n_assigned", F.lit(0))).withColumn("fraction_assigned", F.col("n_assigned") / n)
    return {"model_comparison": comparison, "component_summary": parts, "assignments": assigned}
