"""The four analyses end to end: validated input, descriptors, similarities, summaries, audited output.

Each returns its tables by name and, given a directory, writes them with the run's parameters.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.functions import bits, smiles
from rootgraph.operators import graph, metrics, similarity, stats
from rootgraph.operators.mixtures import mixtures
from rootgraph.operators.nearest import nearest
from rootgraph.operators.quantiles import summary
from rootgraph.sources import tables
from rootgraph.sources.shared import stored

DESCRIPTORS = ("circular_O", "circular_marker", "rooted_wl", "directed_path")
REFERENCE = "circular_O"


@dataclass(frozen=True)
class Config:
    """Parameters of all analyses; ``validate`` rejects unusable ones."""

    n_bits: int = 1024
    radius: int = 3
    max_edges: int = 6
    marker: str = "Hg"
    replacement: str = "O"
    neighbor_k: tuple[int, ...] = (5, 10)
    batch_size: int = 1000
    sample_size: int = 10_000
    seed: int = 123
    bootstrap: int = 2000
    ranking: int = 20
    n_pairs: int = 100_000
    topology_k: tuple[int, ...] = (1, 5, 10, 20)
    neighbor_ids: int = 2000
    components: tuple[int, ...] = (1, 2, 3, 4)
    primary: int = 2

    def validate(self) -> Config:
        if min(self.n_bits, self.max_edges, self.batch_size, self.sample_size, self.bootstrap, self.ranking, self.n_pairs, self.neighbor_ids, *self.neighbor_k, *self.topology_k) < 1 or self.radius < 0:
            raise ValueError("sizes must be positive and the radius not negative")
        if self.primary not in self.components:
            raise ValueError("the primary number of components must be among those fitted")
        return self

    @property
    def words(self) -> int:
        return -(-self.n_bits // 64)


#: a caller's own descriptor: rooted graph rows and the parameters -> a column of on-bits (array<int>)
Descriptor = Callable[[DataFrame, Config], Column]


def names_of(extra: dict[str, Descriptor] | None) -> list[str]:
    """The descriptors in order, a caller's own last."""
    if taken := set(extra or {}) & set(DESCRIPTORS):
        raise ValueError(f"descriptors that are there already: {sorted(taken)}")
    return [*DESCRIPTORS, *(extra or {})]


def fingerprints(df: DataFrame, keys: list[str], column: str, config: Config, unrooted: str | None = None, extra: dict[str, Descriptor] | None = None) -> DataFrame:
    """(keys..., descriptor, on_bits, words) of the structures in a column under the four descriptors, and those of ``extra``.

    The reference descriptor reads the marker as another atom, or the structures of ``unrooted`` as they are. A
    structure of either column that cannot be read, or whose graph breaks a rule of rooted graphs, is an error.
    Texts are read once; a row becomes its rooted and its plain graph, and each of these the descriptors that it has.
    """
    names_of(extra)
    both = smiles.read_both(df.select(*keys, *dict.fromkeys([column, *([unrooted] if unrooted else [])])), column, unrooted, config.marker, config.replacement)
    g = both.select(*keys, F.posexplode("both").alias("_plain", "_g")).select(*keys, "_plain", "_g.*")
    rooted = F.col("_plain") == 0
    g = graph.rooted(g)
    rules = F.when(rooted, F.nullif(graph.violations(g), F.array().cast("array<string>")))
    broken = F.coalesce(F.col("error"), F.concat(F.lit("not a rooted graph: "), F.array_join(rules, ", ")))
    g = graph.pin(g, "_ok", F.when(broken.isNotNull(), F.raise_error(broken).cast("int")).otherwise(1)).drop("_ok")
    g = graph.circular_fingerprint(g, config.radius, config.n_bits).withColumnRenamed("on_bits", "_undirected")
    g = g.withColumn("nodes", F.when(rooted, F.col("nodes")))  # the rest is of rooted graphs only
    g = graph.wl_fingerprint(g, config.radius, config.n_bits).withColumnRenamed("on_bits", "_directed")
    g = graph.with_paths(g, config.max_edges)
    of = lambda name, on: F.struct(F.lit(name).alias("descriptor"), on.cast("array<int>").alias("on_bits"))
    sorted_ = lambda on: F.array_sort(F.array_distinct(on))
    found = [of(DESCRIPTORS[1], F.col("_undirected")), of(DESCRIPTORS[2], F.col("_directed")), of(DESCRIPTORS[3], sorted_(graph.path_bits(F.col("paths"), config.n_bits)))]
    found += [of(name, sorted_(own(g, config))) for name, own in (extra or {}).items()]
    out = g.select(*keys, F.explode(F.when(rooted, F.array(*found)).otherwise(F.array(of(DESCRIPTORS[0], F.col("_undirected"))))).alias("_f"))
    return out.select(*keys, "_f.*").withColumn("words", bits.pack(F.col("on_bits"), config.n_bits))


def _finish(spark: SparkSession, results: dict[str, DataFrame], directory: str | None, name: str, config: Config, path: object, overwrite: bool) -> dict[str, DataFrame]:
    if directory:
        meta = {"analysis": name, "parameters": dataclasses.asdict(config), "spark": spark.version}
        if isinstance(path, str):
            meta["input"] = [r.asDict() for r in tables.fingerprint(spark, path).collect()]
        tables.save(spark, results, directory, meta, overwrite)
    return results


def _preservation(long: DataFrame, first: str, second: str, group: list[str], rows: DataFrame, k: int) -> DataFrame:
    top = lambda v: similarity.top_k(long.select(*group, "i", "j", v), v, k, group).select(*group, "i", "j")
    return similarity.preservation(rows, top(first), top(second), k, group).withColumnRenamed("preservation", f"top_{k}_neighbor_preservation")


def _ranked(rows: DataFrame, order: list[Column | str], n: int, names: DataFrame, sides: dict[str, str]) -> DataFrame:
    """The first ``n`` rows with the columns of ``names`` (first its id) joined to each id column, under the suffix of its side."""
    top = rows.orderBy(*order).limit(n)
    for column, suffix in sides.items():
        top = top.join(names.toDF(column, *(f"{c}{suffix}" for c in names.columns[1:])), column)
    return top.orderBy(*order)


def run_retention(spark: SparkSession, source: str | DataFrame, config: Config = Config(), directory: str | None = None, overwrite: bool = False, extra: dict[str, Descriptor] | None = None) -> dict[str, DataFrame]:
    """Do products keep the similarities of their building blocks?"""
    data, products = tables.load_retention(spark, source, marker=config.validate().marker)
    long = data.unpivot("bb_id", ["SMILES_BB", *products], "column", "smiles")
    fp = stored(fingerprints(long, ["bb_id", "column"], "smiles", config, extra=extra), "fp")
    n = data.count()
    pairs = similarity.similarities(fp, "bb_id", ["words"], config.words, ["descriptor", "column"], max(1, -(-n // similarity.BLOCK)))
    base = pairs.where("column = 'SMILES_BB'").select("descriptor", "i", "j", F.col("words").alias("block"))
    both = stored(pairs.where("column <> 'SMILES_BB'").withColumnRenamed("column", "product_column").join(base, ["descriptor", "i", "j"]).withColumnRenamed("words", "product"), "both")
    group = ["descriptor", "product_column"]
    found = metrics.agreement(both, "block", "product", group).withColumn("n_molecules", F.lit(n))
    rows = both.select(*group).distinct().crossJoin(F.broadcast(data.select(F.col("bb_id").alias("i"))))
    for k in config.neighbor_k:
        if k >= n:
            raise ValueError(f"k={k} needs more than {n} molecules")
        found = found.join(_preservation(both, "block", "product", group, rows, k), group)
    values = ["spearman", "pearson", *(f"top_{k}_neighbor_preservation" for k in config.neighbor_k)]
    found = stored(found, "found")
    results = {
        "per_partner_metrics": found,
        "descriptor_summary": found.groupBy("descriptor").agg(F.count("*").alias("n_partners"), F.first("n_molecules").alias("n_molecules"), *metrics.spread(values)),
        "paired_descriptor_differences": metrics.deltas(found, "descriptor", REFERENCE, ["product_column"], values),
        "molecule_manifest": data.select("bb_id", "source_row", "SMILES_BB"),
        "similarities": pairs,
    }
    return _finish(spark, results, directory, "retention", config, source, overwrite)


def run_library(spark: SparkSession, source: str | DataFrame, config: Config = Config(), directory: str | None = None, overwrite: bool = False, extra: dict[str, Descriptor] | None = None) -> dict[str, DataFrame]:
    """Do the similarities of two components predict those of their products? Pairs are formed within batches."""
    data = tables.load_library(spark, source, config.validate().marker)
    order = F.sha2(F.concat_ws("|", F.lit(config.seed).cast("string"), "product_id"), 256)
    data = stored(stats.batches(data, config.batch_size, [order, "product_id"]), "data")
    fp = stored(fingerprints(data, ["product_id", "batch"], "SMILES_Product", config, extra=extra), "fp")
    pairs = similarity.similarities(fp, "product_id", ["words"], config.words, ["descriptor", "batch"]).withColumnRenamed("words", "similarity")
    for side in ("BB1", "BB2"):
        parts = tables.component_table(data, side, f"SMILES_{side}")
        own = stored(fingerprints(parts, [side], f"SMILES_{side}", config, extra=extra), "own")
        near = similarity.similarities(own, side, ["words"], config.words, ["descriptor"], similarity.block_count(parts))
        same = own.select("descriptor", F.col(side).alias("i"), F.col(side).alias("j"), F.lit(1.0).alias("words"))
        near = similarity.both_ways(near).unionByName(same).toDF("descriptor", f"{side}_i", f"{side}_j", side)
        names = data.select("product_id", F.col(side).alias("_part"))
        pairs = pairs.join(names.toDF("i", f"{side}_i"), "i").join(names.toDF("j", f"{side}_j"), "j").join(near, ["descriptor", f"{side}_i", f"{side}_j"]).drop(f"{side}_i", f"{side}_j")
    both = pairs.select("descriptor", "batch", "i", "j", "similarity", *(similarity.combine(F.col("BB1"), F.col("BB2"), m).alias(m) for m in ("arithmetic", "geometric")))
    long = stored(both.unpivot(["descriptor", "batch", "i", "j", "similarity"], ["arithmetic", "geometric"], "aggregation", "predicted"), "long")
    group = ["descriptor", "aggregation", "batch"]
    found = metrics.agreement(long, "predicted", "similarity", group).join(long.groupBy(*group).agg(*(c.alias(k) for k, c in metrics.errors(F.col("similarity"), F.col("predicted")).items())), group)
    sizes = data.groupBy("batch").agg(F.count("*").alias("n_products"))
    least = sizes.agg(F.min("n_products")).first()[0]
    rows = long.select("descriptor", "aggregation").distinct().crossJoin(F.broadcast(data.select("batch", F.col("product_id").alias("i"))))
    for k in config.neighbor_k:
        if k >= least:
            raise ValueError(f"k={k} needs more than {least} products in a batch")
        found = found.join(_preservation(long, "predicted", "similarity", group, rows, k), group)
    found = stored(found.join(sizes, "batch"), "found")
    values = ["spearman", "pearson", *(f"top_{k}_neighbor_preservation" for k in config.neighbor_k), "mae", "rmse"]
    key = F.xxhash64(F.lit(config.seed), "i", "j")
    first = long.where("batch = 0")
    chosen = first.select("i", "j").distinct().orderBy(key, "i", "j").limit(config.sample_size)
    results = {
        "per_batch_metrics": found,
        "descriptor_summary": found.groupBy("descriptor", "aggregation").agg(F.count("*").alias("n_batches"), F.sum("n_products").alias("n_products_total"), F.sum("n_pairs").alias("n_pairs_total"), *metrics.spread(values)),
        "paired_descriptor_differences": (paired := metrics.deltas(found, "descriptor", REFERENCE, ["aggregation", "batch"], values)),
        "mean_descriptor_differences": metrics.mean_deltas(paired, ["descriptor", "aggregation"], values),
        "batch_audit": metrics.batch_audit(data, "product_id"),
        "batch_manifest": data.select("batch", "within_batch_order", "product_id", "source_row", "BB1", "BB2"),
        "representative_pair_samples": first.join(chosen, ["i", "j"]).select("descriptor", "aggregation", "batch", "predicted", "similarity"),
        "dataset_summary": tables.cartesian(data, "BB1", "BB2"),
    }
    return _finish(spark, results, directory, "library", config, source, overwrite)


def run_attachment(spark: SparkSession, source: str | DataFrame, config: Config = Config(), directory: str | None = None, overwrite: bool = False, extra: dict[str, Descriptor] | None = None) -> dict[str, DataFrame]:
    """Are attachment positions of one scaffold told apart more than scaffolds at one position?"""
    every = names_of(extra)
    data = stored(tables.load_scaffolds(spark, source, config.validate().marker), "data")
    fp = stored(fingerprints(data, ["molecule_id"], "SMILES_Structure", config, extra=extra), "fp")
    wide = fp.groupBy("molecule_id").pivot("descriptor", every).agg(F.first("words"))
    rows = data.select("molecule_id", F.col("Position").alias("position"), F.col("canonical_scaffold").alias("scaffold"), F.col("canonical_structure").alias("structure")).join(wide, "molecule_id")
    pairs = similarity.classified_pairs(rows, "molecule_id", "scaffold", "position", "structure")
    pairs = pairs.withColumns({f"{d}_distance": 1 - bits.tanimoto(F.col(f"{d}_i"), F.col(f"{d}_j"), config.words) for d in every}).drop(*(f"{d}_{s}" for d in every for s in "ij"))
    others = [d for d in every if d != REFERENCE]
    pairs = stored(pairs.withColumns({f"{d}_minus_reference": F.col(f"{d}_distance") - F.col(f"{REFERENCE}_distance") for d in others}), "pairs")
    long = pairs.unpivot(["pair_group", "cluster_id"], [f"{d}_minus_reference" for d in others], "descriptor", "delta")
    names, sides = data.select("molecule_id", "SMILES_Structure", "SMILES_Scaffold"), {"molecule_id_i": "_i", "molecule_id_j": "_j"}
    clusters = long.groupBy("pair_group", "descriptor").agg(F.count_distinct("cluster_id").alias("n"))
    group = ["pair_group", "descriptor"]
    results = {
        "molecule_manifest": data,
        "pairwise_comparison": pairs,
        "group_summary": metrics.group_summary(pairs, every, REFERENCE),
        "bootstrap_summary": stats.cluster_bootstrap(long, "cluster_id", "delta", stats.hashed_draws(clusters, group, config.bootstrap, config.seed), group),
        "fingerprint_summary": metrics.bit_density(fp, ["descriptor"], "on_bits", config.n_bits),
        **{f"ranked_{d}_gain": _ranked(pairs, [F.col(f"{d}_minus_reference").desc(), *sides], config.ranking, names, sides) for d in others},
        "ranked_reference_gain": _ranked(pairs, ["rooted_wl_minus_reference", *sides], config.ranking, names, sides),
    }
    return _finish(spark, results, directory, "attachment", config, source, overwrite)


def run_topology(spark: SparkSession, source: str | DataFrame, columns: tuple[str, ...], config: Config = Config(), directory: str | None = None, overwrite: bool = False, extra: dict[str, Descriptor] | None = None) -> dict[str, DataFrame]:
    """Are two topologies of the same molecule told apart? ``columns``: id, two unrooted and two rooted structures."""
    every = names_of(extra)
    data = stored(tables.load_matched(spark, source, columns, config.validate().marker).withColumnRenamed(columns[0], "ID"), "data")
    sides = [fingerprints(data, ["ID"], columns[3 + t], config, columns[1 + t], extra).withColumn("topology", F.lit(t + 1)) for t in (0, 1)]
    fp = stored(graph.union_all(sides), "fp")
    wide = stored(fp.groupBy("ID", "descriptor").pivot("topology", [1, 2]).agg(F.first("words")).toDF("ID", "descriptor", "w1", "w2"), "wide")
    apart = lambda a, b: 1 - bits.tanimoto(F.col(a), F.col(b), config.words)
    matched = wide.select("ID", "descriptor", apart("w1", "w2").alias("distance"))
    flat = matched.groupBy("ID").pivot("descriptor", every).agg(F.first("distance"))
    others = [d for d in every if d != REFERENCE]
    flat = stored(flat.withColumns({f"{d}_minus_reference": F.col(d) - F.col(REFERENCE) for d in others}), "flat")
    drawn = similarity.sampled_pairs(data, "ID", config.n_pairs, config.seed)
    x, y = (wide.select(F.col("ID").alias(s), "descriptor", F.col("w1").alias(f"{s}1"), F.col("w2").alias(f"{s}2")) for s in "ij")
    c = drawn.join(x, "i").join(y, ["j", "descriptor"]).select("pair_number", "i", "j", "descriptor", apart("i1", "j1").alias("within_1"), apart("i2", "j2").alias("within_2"), apart("i1", "j2").alias("cross_12"), apart("i2", "j1").alias("cross_21"))
    within, cross = (F.col("within_1") + F.col("within_2")) / 2, (F.col("cross_12") + F.col("cross_21")) / 2
    c = stored(c.withColumns({"within_mean_distance": within, "cross_mean_distance": cross, "topology_separation": cross - within}), "c")
    base = c.where(F.col("descriptor") == REFERENCE).select("pair_number", F.col("topology_separation").alias("_s"))
    more = c.where(F.col("descriptor") != REFERENCE).join(base, "pair_number").withColumn("d", F.col("topology_separation") - F.col("_s"))
    ids = data.select("ID").orderBy(F.xxhash64(F.lit(config.seed), "ID"), "ID").limit(config.neighbor_ids)
    lib = fp.join(ids, "ID").select("descriptor", F.concat_ws("|", F.col("topology").cast("string"), "ID").alias("id"), "words")
    near = nearest(lib, lib, "id", "words", config.words, max(config.topology_k), ["descriptor"]).withColumnsRenamed({"query": "i", "match": "j"})
    near = near.withColumn("same", (F.substring("i", 1, 1) == F.substring("j", 1, 1)).cast("double")).withColumn("k", F.explode(F.array(*map(F.lit, config.topology_k)))).where("rank <= k")
    asked = near.groupBy("descriptor", "i", "k").agg(F.avg("same").alias("same_topology_fraction"), F.count("*").alias("effective_k"))
    fitted = mixtures(flat, "ID", "rooted_wl_minus_reference", config.components, config.primary, config.seed)
    names = data.select("ID", *columns[1:])
    types = metrics.pair_types(c, ["pair_number"])
    long = flat.unpivot("ID", [*every, *(f"{d}_minus_reference" for d in others)], "descriptor", "d")
    results = {
        "dataset_summary": data.agg(F.count("*").alias("n_ids"), F.count_distinct("ID").alias("n_distinct")),
        "fingerprint_summary": metrics.bit_density(fp, ["descriptor", "topology"], "on_bits", config.n_bits),
        "matched_pair_distances": flat,
        "matched_summary": metrics.distances(long, ["descriptor"], "d"),
        "controlled_pair_distances": c,
        "topology_separation_summary": metrics.separations(c, ["descriptor"]),
        "descriptor_comparison": summary(more, ["descriptor"], [F.avg("d").alias("mean_separation_difference"), F.avg((F.col("d") > 0).cast("double")).alias("fraction_greater_separation"), metrics.effect_size("d").alias("paired_effect_size_difference")], {"median_separation_difference": ("d", 0.5)}),
        "pair_type_summary": metrics.pair_type_summary(types),
        "pair_type_differences": metrics.pair_type_differences(types, ["pair_number"], REFERENCE),
        "neighbor_query_results": asked,
        "neighbor_summary": summary(asked, ["descriptor", "k"], [F.count("*").alias("n_queries"), F.avg("same_topology_fraction").alias("mean"), F.stddev_samp("same_topology_fraction").alias("std")], {"median": ("same_topology_fraction", 0.5)}, keep=True),
        **{f"ranked_{d}_gain": _ranked(flat, [F.col(f"{d}_minus_reference").desc(), "ID"], config.ranking, names, {"ID": ""}) for d in others},
        "ranked_reference_favored": _ranked(flat, ["rooted_wl_minus_reference", "ID"], config.ranking, names, {"ID": ""}),
        **{f"population_{k}": v for k, v in fitted.items()},
    }
    return _finish(spark, results, directory, "topology", config, source, overwrite)
