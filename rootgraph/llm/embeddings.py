"""Operator 9: near-duplicate embeddings by an inverted multi-index over two codebooks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import components, table, written

THRESHOLD = 0.98
#: vectors from which the codebooks are learned, and the most numbers these may hold
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: distinct vectors for each cell of the product grid, the most centroids of a half, and the largest block compared at once
PER_CELL, MOST_CENTROIDS, BLOCK = 32, 1024, 1024
#: share of links that the traversal must reach, and the vectors whose links, found by brute force, say how far that is
TARGET_RECALL, PROBES, STEPS = 0.999, 1024, 1024


def unit(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids of the rows of x, from a fixed seed; at most as many as there are different rows."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:k]]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (mine := near == j).any():
                c[j] = x[mine].mean(axis=0)
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and for each centroid the least squared distance from the row to its cell."""
    d = np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T)
    near = np.argmin(d, axis=1)
    apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)))[near]
    gap = np.maximum(0, d - d[np.arange(len(x)), near][:, None] - 1e-9) / np.where(apart > 0, 2 * apart, 1)
    return near, np.where(apart > 0, gap * gap, 0)


def visits(b1: np.ndarray, b2: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal: (row, i, j) of the cells whose bounds sum to ``radius2`` at most, nearest first.

    Both halves are walked in order of their bounds, so it stops at the first cell beyond the radius;
    a vector within that radius lies in no later cell.
    """
    o1, o2 = np.argsort(b1, axis=1, kind="stable"), np.argsort(b2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(b1, o1, 1), np.take_along_axis(b2, o2, 1)
    rows, i, j = [], [], []
    for p in range(s1.shape[1]):
        room = radius2 - s1[:, p]
        live = np.flatnonzero(room >= 0)
        if not len(live):
            break
        r, q = np.nonzero(s2[live] <= room[live, None])
        rows.append(live[r])
        i.append(o1[live[r], p])
        j.append(o2[live[r], q])
    return np.concatenate(rows), np.concatenate(i), np.concatenate(j)


def _index(vectors: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], radius2: float) -> DataFrame:
    """Adds the home cell and the cells to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = unit(part.column(2))
                one = np.zeros((1, d // 2)), np.zeros((1, d - d // 2))
                c1, c2 = books.get(int(d), one)
                (n1, b1), (n2, b2) = bounds(x[:, : d // 2], c1), bounds(x[:, d // 2 :], c2)
                row, i, j = visits(b1, b2, radius2)
                order = np.argsort(row, kind="stable")
                off = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(off), pa.array(i[order] * 65536 + j[order], pa.int64()))
                yield pa.record_batch([*part.columns, pa.array(n1 * 65536 + n2, pa.int64()), cells], [*part.schema.names, "home", "cells"])

    return vectors.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}, home long, cells array<long>")


def reach(merged: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float, target: float) -> float:
    """The bound at which the traversal may stop: what finds ``target`` of the links of some probe vectors.

    The probes (a fixed number, chosen by hash) are compared with all vectors of their label; for each link the bound
    of the cell that holds it counts. A probe's links share a weight of one, so that those of a few with very many
    copies, which lie near, do not decide for the rest. The least answer is that for a difference of the greatest length in a random
    direction, two standard deviations out.
    """
    probes = merged.orderBy("h1", "h2", "rep").select("rep", "label", "vec").limit(PROBES).collect()
    radius2 = 2 - 2 * threshold + 1e-9
    by: dict[tuple[str, int], list] = {}
    for at, r in enumerate(probes):
        by.setdefault((r.label, len(r.vec)), []).append(Row(at=at, rep=r.rep, vec=r.vec))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(probes), STEPS + 1), np.int64)
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy()
            for (label, d), rows in by.items():
                part = batch.filter(pc.and_(pc.equal(batch.column(1), label), pa.array(dims == d)))
                if not part.num_rows or int(d) not in books:
                    continue
                x, q = unit(part.column(2)), unit(pa.array([r.vec for r in rows]))
                i, j = np.nonzero((q @ x.T >= threshold) & (np.array([r.rep for r in rows])[:, None] != part.column(0).to_numpy()[None, :]))
                c1, c2 = books[int(d)]
                (_, b1), (_, b2) = bounds(q[:, : d // 2], c1), bounds(q[:, d // 2 :], c2)
                (n1, _), (n2, _) = bounds(x[:, : d // 2], c1), bounds(x[:, d // 2 :], c2)
                need = np.minimum((b1[i, n1[j]] + b2[i, n2[j]]) / radius2, 1)
                np.add.at(total, (np.array([r.at for r in rows])[i], np.ceil(need * STEPS).astype(np.int64)), 1)
        at, step = np.nonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(step), pa.array(total[at, step])], ["at", "step", "n"])

    if target >= 1:
        return radius2
    least = radius2 * 4 / max((d for _, d in by), default=1)
    found = merged.select("rep", "label", "vec").mapInArrow(near, "at long, step long, n long").groupBy("at", "step").agg(F.sum("n").alias("n")).collect()
    links, weight = Counter(), Counter()
    for r in found:  # at most a row for each probe and step
        links[r.at] += r.n
    for r in found:
        weight[r.step] += r.n / links[r.at]
    seen = 0.0
    for step in sorted(weight):
        seen += weight[step]
        if seen >= target * len(links) - 1e-9:
            return min(radius2, max(least, radius2 * step / STEPS))
    return min(radius2, least)


def _links(groups: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], radius2: float, threshold: float) -> DataFrame:
    """Of rows (key, side, rep, n, home, vec) sorted by key: (a, links) that each vector gains, and (a, b) that join what is linked.

    A link found by one of its ends counts for both: the vector that asks always counts it, the one that is held only if it
    does not visit the home of the other, where it would find it itself.
    """

    def block(ask: tuple, held: tuple) -> tuple[list, list, list]:
        (ra, n_a, home, xa), (rb, nb, _, xb) = ask, held
        linked = (xa @ xb.T >= threshold) & (ra[:, None] != rb[None, :])
        count = linked @ nb
        d = xb.shape[1]
        c1, c2 = books.get(d, (np.zeros((1, d // 2)), np.zeros((1, d - d // 2))))
        b1, b2 = bounds(xb[:, : d // 2], c1)[1], bounds(xb[:, d // 2 :], c2)[1]
        finds = (b1[:, home // 65536] + b2[:, home % 65536] <= radius2).T
        back = (linked & ~finds).T @ n_a
        la, lb = ra.copy(), rb.copy()
        big = np.iinfo(np.int64).max
        while True:  # smallest vector of each component within the block
            na = np.minimum(la, np.where(linked, lb[None, :], big).min(axis=1))
            n2 = np.minimum(lb, np.where(linked, na[:, None], big).min(axis=0))
            if (na == la).all() and (n2 == lb).all():
                break
            la, lb = na, n2
        ids, low = np.concatenate([ra, rb]), np.concatenate([la, lb])
        joined = low != ids
        some, more = count > 0, back > 0
        gained = [*ra[some], *rb[more]]
        return [*gained, *ids[joined]], [*[None] * len(gained), *low[joined]], [*count[some], *back[more], *[None] * int(joined.sum())]

    def whole(t: pa.Table) -> pa.RecordBatch:
        key, side = t.column("key").combine_chunks(), t.column("side").to_numpy()
        codes = key.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.diff(codes)) + 1
        rep, n, home = (t.column(c).to_numpy() for c in ("rep", "n", "home"))
        vec = t.column("vec").combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(codes)], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo < mid < hi:
                x = unit(vec.slice(lo, hi - lo))
                for into, more in zip(out, block((rep[mid:hi], n[mid:hi], home[mid:hi], x[mid - lo :]), (rep[lo:mid], n[lo:mid], home[lo:mid], x[: mid - lo])), strict=True):
                    into.extend(more)
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column("key")
            same = pc.equal(key, key[-1]).to_numpy()
            first = int(np.argmax(same))  # sorted: the last key's rows stand together at the end
            if first:
                yield whole(held.slice(0, first))
                held = held.slice(first)
        if held is not None and held.num_rows:
            yield whole(held)

    return groups.mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine in double precision is ``threshold`` or more.

    Equal vectors are merged; the rest are split into halves, each with its own codebook learned from a
    bounded sample, which gives a product grid of cells. Each vector visits cells, nearest first, up to the bound
    that reaches the target recall (``reach``; 1 visits every cell that can hold a link); candidates are verified in
    blocks, so that a cell of many vectors is spread over many tasks and is never emitted as pairs.
    Returns vec_id, n_links, component_id, kept for every row. Vectors that are null, empty, zero, or hold null
    or non-finite numbers, null ids, and rows with a null label have no links and are their own component;
    vectors of different lengths never link. Ids are taken as unique; a repeated row counts as another vector. An empty
    table gives no rows; very long vectors are compared whole; other columns of any name are ignored. ``n_links`` has two
    ends: a link that either vector finds counts for both.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector_col, lambda x: x != 0)
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    usable = F.coalesce(usable & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"), usable.alias("usable"))
    key = ["label", "h1", "h2"]
    good = rows.where("usable").select("vec_id", "vec", "label", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2"))
    merged = written(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    stats = merged.agg(F.count("*"), F.max(F.size("vec"))).first()
    if stats[0]:
        least = max(1, min(SAMPLE, SAMPLE_VALUES // stats[1]))
        sample = merged.orderBy("h1", "h2", "rep").select("vec").limit(least).toArrow().column("vec").combine_chunks()
        k = int(np.clip(np.ceil(np.sqrt(stats[0] / PER_CELL)), 1, MOST_CENTROIDS))
        dims = pc.list_value_length(sample).to_numpy()
        for d in np.unique(dims):
            x = unit(sample.filter(pa.array(dims == d)))
            books[int(d)] = codebook(x[:, : d // 2], k), codebook(x[:, d // 2 :], k)

    stop = reach(merged, books, threshold, target) if books else 0.0
    found = _index(merged.select("rep", "n", "vec", "label"), books, stop)
    found = written(found.withColumn("dim", F.size("vec")), "index")
    cell = ["label", "dim", "cell"]
    held = found.select("label", "dim", F.col("home").alias("cell"), "rep", "n", "home", "vec")
    ask = found.select("label", "dim", F.explode("cells").alias("cell"), "rep", "n", "home", "vec")
    blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = blocks(held, "gh").join(blocks(ask, "ga"), cell)
    split = lambda df, own, other, side: df.join(grid, cell).select(
        *cell, "rep", "n", "home", "vec", F.lit(side).alias("side"), F.pmod(F.xxhash64("rep"), F.col(own)).alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other")
    )
    named = lambda df, h, a: df.select(F.concat_ws("|", "label", "dim", "cell", h, a).alias("key"), "side", "rep", "n", "home", "vec")
    both = named(split(held, "gh", "ga", 0), "own", "other").union(named(split(ask, "ga", "gh", 1), "other", "own"))
    links = written(_links(both.repartition("key").sortWithinPartitions("key", "side"), books, stop, threshold), "links")

    count = links.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    parts = components(links.where("b is not null").select("a", "b"))
    out = merged.select(*key, "rep", "n").join(count, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select(*key, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", *key).join(out, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: brute force in SQL is quadratic within a label only; it serves as the check at small scale
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) x ON vec_id = x.a LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) y ON vec_id = y.a
"""
