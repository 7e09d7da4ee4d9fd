"""Rooted graphs as rows, and their descriptors as column expressions.

A graph row holds ``nodes`` array<struct<id, invariant>>, ``root`` (place of the root in nodes), and ``bonds``
array<struct<a, b, type, ring>> with places of the ends. All work is local to the row and stays in the JVM, so
building graphs from tables costs one shuffle and descriptors none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootgraph.functions.bits import fold
from rootgraph.functions.environments import with_environments

#: classes of bonds in path descriptors (fixed values)
BOND_CLASS = {"SINGLE": 1, "DOUBLE": 2, "TRIPLE": 3, "AROMATIC": 4}


class GraphError(ValueError):
    """An input that cannot be made into a rooted graph, or an unusable parameter."""


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row however often later expressions use it.

    The optimizer may copy a projected expression into each of its uses, even inside lambdas; it does not do so
    across a generator of one row.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def build(nodes: DataFrame, bonds: DataFrame, graph: str = "g") -> DataFrame:
    """Graph rows from node rows (g, id, invariant, is_root) and bond rows (g, a, b, type, ring) that name node ids."""
    own = nodes.select(graph, F.struct("id", "invariant", "is_root").alias("node"))
    return gathered(own.unionByName(bonds.select(graph, F.array(F.struct("a", "b", "type", "ring")).alias("bonds")), allowMissingColumns=True), graph)


def gathered(rows: DataFrame, graph: str = "g") -> DataFrame:
    """Graph rows from rows (g, node, bonds) of a node struct and an array of bond structs as in ``build``, either of which may be null.

    One aggregation: rows that are dealt by g are not moved again.
    """
    made = rows.groupBy(graph).agg(F.sort_array(F.collect_list("node")).alias("n"), F.sort_array(F.flatten(F.collect_list("bonds"))).alias("b"))
    place = lambda x: (F.array_position(F.col("n.id"), x) - 1).cast("int")
    none = F.array().cast("array<struct<a:int,b:int,type:string,ring:boolean>>")
    named = F.transform("b", lambda e: F.struct(place(e["a"]).alias("a"), place(e["b"]).alias("b"), e["type"].alias("type"), e["ring"].alias("ring")))
    return made.where(F.size("n") > 0).select(
        graph,
        (F.array_position(F.transform("n", lambda x: x["is_root"]), True) - 1).cast("int").alias("root"),
        F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["invariant"].alias("invariant"))).alias("nodes"),
        F.when(F.col(graph).isNotNull(), named).otherwise(none).alias("bonds"),
    )


def with_depths(graphs: DataFrame) -> DataFrame:
    """Adds ``depths``: shortest distance from the root for each node, null where it cannot be reached.

    Goes out from the root over lists of neighbours made once; each round takes the nodes met first in the last one, and
    rounds after the last such node do nothing.
    """
    n, none = F.size("nodes"), F.array().cast("array<int>")
    other = lambda i: lambda e: F.when(e["a"] == i, e["b"]).otherwise(e["a"])
    out = pin(graphs, "_near", F.transform("nodes", lambda _, i: F.transform(F.filter("bonds", lambda e: (e["a"] == i) | (e["b"] == i)), other(i))))
    front = F.when(F.col("root").between(0, n - 1), F.array(F.col("root").cast("int"))).otherwise(none)
    start = F.struct(front.alias("seen"), F.transform(front, lambda _: F.lit(0)).alias("far"), front.alias("front"))

    def spread(acc: Column, depth: Column) -> Column:
        met = F.array_except(F.flatten(F.transform(acc["front"], lambda i: F.col("_near")[i])), acc["seen"])
        more = lambda m: F.struct(F.concat(acc["seen"], m).alias("seen"), F.concat(acc["far"], F.array_repeat(depth, F.size(m))).alias("far"), m.alias("front"))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.transform(F.array(met), more)[0])

    def by_node(acc: Column) -> Column:
        met = F.zip_with(acc["seen"], acc["far"], lambda i, d: F.struct(i.alias("i"), d.alias("d")))
        rest = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), acc["seen"]), lambda i: F.struct(i.alias("i"), F.lit(None).cast("int").alias("d")))
        return F.sort_array(F.concat(met, rest)).getField("d")

    some = F.col("nodes").isNotNull()
    found = F.aggregate(F.sequence(F.lit(1), n), start, spread, by_node)
    return pin(out, "depths", F.when(some & (n > 0), found).when(some, none)).drop("_near")


def with_edges(graphs: DataFrame) -> DataFrame:
    """Adds ``edges`` (src, dst, type, ring, lateral): bonds point away from the root, level ones both ways."""

    def orient(e: Column) -> Column:
        a, b = F.col("depths")[e["a"]], F.col("depths")[e["b"]]
        edge = lambda s, t, level: F.struct(s.alias("src"), t.alias("dst"), e["type"].alias("type"), e["ring"].alias("ring"), F.lit(level).alias("lateral"))
        return F.when(a < b, F.array(edge(e["a"], e["b"], False))).when(b < a, F.array(edge(e["b"], e["a"], False))).otherwise(F.array(edge(e["a"], e["b"], True), edge(e["b"], e["a"], True)))

    return pin(graphs, "edges", F.flatten(F.transform("bonds", orient)))


def rooted(graphs: DataFrame) -> DataFrame:
    return with_edges(with_depths(graphs))


def violations(graphs: DataFrame) -> Column:
    """Names of the rules that a row breaks (empty if it is a sound rooted graph)."""
    n = F.size("nodes")
    key = lambda e: F.concat_ws("|", e["src"].cast("string"), e["dst"].cast("string"), e["type"], e["ring"].cast("string"))
    twin = lambda e: F.concat_ws("|", e["dst"].cast("string"), e["src"].cast("string"), e["type"], e["ring"].cast("string"))
    keys = F.transform("edges", key)
    depth = lambda i: F.col("depths")[i]
    known = F.forall("edges", lambda e: e["src"].between(0, n - 1) & e["dst"].between(0, n - 1))
    rules = {
        "root missing": F.col("root").isNull() | (F.col("root") < 0) | (F.col("root") >= n),
        "root not at depth zero": F.get("depths", F.col("root")) != 0,
        "nodes and depths differ": F.size("depths") != n,
        "node unreachable": F.exists("depths", lambda d: d.isNull()),
        "duplicate node": F.size(F.array_distinct("nodes.id")) != n,
        "duplicate edge": F.size(F.array_distinct(keys)) != F.size("edges"),
        "unknown node": ~known,
        "inward edge": F.exists("edges", lambda e: depth(e["src"]) > depth(e["dst"])),
        "level edge without its reverse": F.exists("edges", lambda e: (depth(e["src"]) == depth(e["dst"])) & ~F.array_contains(keys, twin(e))),
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())


def initial_labels() -> Column:
    """Text labels: ROOT for the root, else the invariant."""
    return F.transform("nodes", lambda x, i: F.when(i == F.col("root"), F.lit("ROOT")).otherwise(x["invariant"].cast("string")))


def _with_incident(graphs: DataFrame, directed: bool) -> DataFrame:
    """Adds ``_incident``: what each node sees of its neighbours, as incoming, outgoing and lateral ends (one list if undirected).

    A level bond is stored both ways and is seen from both of its ends, so a lateral neighbour counts twice. Edges are
    looked through once for each node, not again in each round.
    """
    end = lambda to: lambda e: F.struct(e["type"].alias("type"), e["ring"].cast("int").cast("string").alias("ring"), to(e).alias("to"))
    into = lambda i, keep: F.transform(F.filter("edges", lambda e: (e["dst"] == i) & keep(e)), end(lambda e: e["src"]))
    out = lambda i, keep: F.transform(F.filter("edges", lambda e: (e["src"] == i) & keep(e)), end(lambda e: e["dst"]))
    slope, level = (lambda e: ~e["lateral"]), (lambda e: e["lateral"])

    def seen(_: Column, i: Column) -> Column:
        if directed:
            return F.array(into(i, slope), out(i, slope), F.concat(into(i, level), out(i, level)))
        other = lambda e: F.when(e["a"] == i, e["b"]).otherwise(e["a"])
        return F.array(F.transform(F.filter("bonds", lambda e: (e["a"] == i) | (e["b"] == i)), end(other)))

    return pin(graphs, "_incident", F.transform("nodes", seen))


def _refined(labels: Column, directed: bool) -> Column:
    text = lambda e: F.concat_ws(",", e["type"], e["ring"], labels[e["to"]])
    part = lambda i, k: F.array_join(F.sort_array(F.transform(F.col("_incident")[i][k], text)), ";")
    return F.transform(labels, lambda x, i: F.sha2(F.concat_ws("|", x, *(part(i, k) for k in range(3 if directed else 1))), 256))


def _numbered(r: int) -> Column:
    return F.transform(f"_l{r}", lambda x: F.struct(F.lit(r).alias("iteration"), x.alias("label")))


def refine(graphs: DataFrame, radius: int = 3, directed: bool = True) -> DataFrame:
    """Adds ``features``: array<struct<iteration, label>> of rounds 0 to ``radius`` of neighbourhood refinement.

    Labels are kept as digests of their text, which are equal when the nested labels are. ``directed=False``
    ignores orientation and gives the features of an ordinary circular fingerprint.
    """
    if radius < 0:
        raise GraphError(f"radius must not be negative, not {radius}")
    out = graphs.withColumn("_l0", initial_labels() if directed else F.transform("nodes", lambda x: x["invariant"].cast("string")))
    if radius:
        out = _with_incident(out, directed)
    for r in range(1, radius + 1):
        last = F.col(f"_l{r - 1}")
        out = pin(out, f"_l{r}", _refined(last, directed))
    rounds = [_numbered(r) for r in range(radius + 1)]
    return out.withColumn("features", F.concat(*rounds)).drop("_incident", *(f"_l{r}" for r in range(radius + 1)))


def fold_features(features: Column, n_bits: int) -> Column:
    """Sorted on-bits of a feature array."""
    return F.sort_array(F.array_distinct(F.transform(features, lambda f: fold(F.sha2(F.concat_ws(":", f["iteration"].cast("string"), f["label"]), 256), n_bits))))


def _grown(graphs: DataFrame, max_edges: int, classes: dict[str, int] | None, mark: Callable[[Column], Column] | None) -> DataFrame:
    """Adds ``paths``: array<struct<nodes, last, marks>>, the digest of each path as ``last``, and the mark of every suffix's digest if one is asked for."""
    if max_edges < 1:
        raise GraphError(f"a path has at least one edge, not {max_edges}")
    classes = classes or BOND_CLASS
    code = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    kind = lambda e: F.coalesce(F.try_element_at(code, F.upper(F.trim(e["type"]))).cast("string"), F.raise_error(F.concat(F.lit("unsupported bond type "), e["type"])).cast("string"))
    out = pin(graphs, "_seed", F.transform("nodes", lambda x, i: F.sha2(F.when(i == F.col("root"), F.lit("'ROOT'")).otherwise(x["invariant"].cast("string")), 256)))
    seed = F.col("_seed")
    link = lambda h, e: F.sha2(F.concat_ws("|", h, e["kind"], seed[e["src"]]), 256)
    ends = F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), kind(e).alias("kind")))
    out = pin(out, "_ends", ends)
    out = pin(out, "_into", F.transform("nodes", lambda _, i: F.filter("_ends", lambda e: e["dst"] == i)))

    def path(nodes: Column, last: Column, marks: Column | None = None) -> Column:
        if mark is None:
            return F.struct(nodes.alias("nodes"), last.alias("last"))
        own = lambda h: F.array(mark(h)) if marks is None else F.concat(marks, F.array(mark(h)))
        return F.transform(F.array(last), lambda h: F.struct(nodes.alias("nodes"), h.alias("last"), own(h).alias("marks")))[0]

    out = pin(out, "_p1", F.transform("_ends", lambda e: path(F.array(e["src"], e["dst"]), link(seed[e["dst"]], e))))
    for k in range(2, max_edges + 1):

        def longer(p: Column) -> Column:
            more = F.filter(F.col("_into")[p["nodes"][0]], lambda e: ~F.array_contains(p["nodes"], e["src"]))
            return F.transform(more, lambda e: path(F.concat(F.array(e["src"]), p["nodes"]), link(p["last"], e), p["marks"] if mark else None))

        out = pin(out, f"_p{k}", F.flatten(F.transform(f"_p{k - 1}", longer)))
    return out.withColumn("paths", F.concat(*(F.col(f"_p{k}") for k in range(1, max_edges + 1)))).drop("_seed", "_ends", "_into", *(f"_p{k}" for k in range(1, max_edges + 1)))


def with_paths(graphs: DataFrame, max_edges: int = 4, classes: dict[str, int] | None = None) -> DataFrame:
    """Adds ``paths``: array<struct<nodes, hashes>> of directed simple paths of 1 to ``max_edges`` edges.

    Paths grow at their upstream end, chaining digests from the tail; ``hashes`` are those of all suffixes of the
    path, so a path of L edges counts L times in count mode. Level edges may be walked both ways.
    """
    made = F.transform("paths", lambda p: F.struct(p["nodes"].alias("nodes"), p["marks"].alias("hashes")))
    return _grown(graphs, max_edges, classes, lambda h: h).withColumn("paths", made)


def path_bits(paths: Column, n_bits: int) -> Column:
    """Bit of every increment, repeats included."""
    return F.transform(F.flatten(F.transform(paths, lambda p: p["hashes"])), lambda h: fold(h, n_bits))


def path_fingerprint(graphs: DataFrame, max_edges: int = 4, n_bits: int = 1024, binary: bool = True, graph: str = "g", classes: dict[str, int] | None = None) -> DataFrame:
    """(g, bit) of directed-path features, or (g, bit, count) if not ``binary``.

    A suffix of a path is a path, so the bits are those of whole paths; counts take a bit of every suffix, folded once.
    """
    if binary:
        bits = F.transform("paths", lambda p: fold(p["last"], n_bits))
        return _grown(graphs, max_edges, classes, None).select(graph, F.explode(F.array_distinct(bits)).alias("bit"))
    bits = _grown(graphs, max_edges, classes, lambda h: fold(h, n_bits)).select(graph, F.explode(F.flatten("paths.marks")).alias("bit"))
    return bits.groupBy(graph, "bit").agg(F.count("*").alias("count"))


def wl_fingerprint(graphs: DataFrame, radius: int = 3, n_bits: int = 1024, directed: bool = True) -> DataFrame:
    """Adds ``on_bits`` of the neighbourhood descriptor."""
    return refine(graphs, radius, directed).withColumn("on_bits", fold_features(F.col("features"), n_bits)).drop("features")


def circular(graphs: DataFrame, radius: int = 3) -> DataFrame:
    """Adds ``features``: array<struct<iteration, label>> of the circular environments of all nodes, without orientation.

    An environment grows from a node over the bonds around it, one bond further in each round. It counts only if no
    environment of the same bonds came before it: of those in one round that with the least label, then the least node,
    counts. A node whose environment does not count stops growing. Round 0 has every node.
    """
    if radius < 0:
        raise GraphError(f"radius must not be negative, not {radius}")
    return graphs.withColumn("features", with_environments(F.transform("nodes", lambda x: x["invariant"].cast("string")), F.col("bonds"), radius))


def circular_fingerprint(graphs: DataFrame, radius: int = 3, n_bits: int = 1024) -> DataFrame:
    """Adds ``on_bits`` of the circular control."""
    return circular(graphs, radius).withColumn("on_bits", fold_features(F.col("features"), n_bits)).drop("features")


def replace_marker(nodes: Column, marker: str, replacement: str) -> Column:
    """Molecular nodes with the marker atom turned into a neutral atom of another element."""
    count = F.size(F.filter(nodes, lambda x: x["element"] == marker))
    new = F.transform(nodes, lambda x: F.when(x["element"] == marker, x.withField("element", F.lit(replacement)).withField("charge", F.lit(0))).otherwise(x))
    return F.when(count == 1, new).otherwise(F.raise_error(F.lit("exactly one marker atom is needed")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
