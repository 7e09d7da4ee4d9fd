"""From bucket memberships to verified links and classes, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootgraph.llm.common import components, discard, written

#: rows on one side of a block of comparisons
BLOCK = 512
#: letters of a part of a cluster
TEXT_BYTES = 8 << 20

#: (ids, labels, payload) of the two sides of a block (one and the same side if the second is None) -> boolean matrix of links
Kernel = Callable[[pa.RecordBatch, pa.RecordBatch | None], np.ndarray]


def by_key(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that stand together by key."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != key:
                yield key, held
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def spanning(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that join what the matrix of links between rows a and columns b joins: (node, smallest of its part)."""
    la, lb, big = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], big).min(axis=1, initial=big))
        nb = np.minimum(lb, np.where(linked, na[:, None], big).min(axis=0, initial=big))
        # a node that stands on both sides has one label
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = np.full(len(ids), big)
        np.minimum.at(low, at, np.concatenate([na, nb]))
        na, nb = low[at[: len(a)]], low[at[len(a) :]]
        if (na == la).all() and (nb == lb).all():
            moved = low != ids
            return ids[moved], low[moved]
        la, lb = na, nb


def parts(rows: DataFrame, block: int = BLOCK, text: str | None = None, letters: str | None = None) -> DataFrame:
    """(cluster, _g): the parts of about ``block`` rows (and of ``TEXT_BYTES`` of the column ``text``, or by ``letters``, its lengths) of each cluster."""
    length = F.col(letters) if letters else F.length(text) if text else None
    n = F.count("*") / block if length is None else F.greatest(F.count("*") / block, F.sum(length) / TEXT_BYTES)
    return rows.groupBy("cluster").agg(F.ceil(n).cast("int").alias("_g"))


def in_blocks(rows: DataFrame, kernel: Kernel, block: int = BLOCK, text: str | None = None, pairs: bool = False, own: int | None = None, size: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between labels that join the rows of each cluster whose pairs the kernel accepts; with ``pairs``, those pairs, a > b.

    ``rows`` holds cluster, id, label and what the kernel needs. A cluster is cut into parts of about ``block`` rows
    (and of ``TEXT_BYTES`` of the column ``text``) and each pair of parts is compared in one step, so no task holds a
    cluster and no pairs are emitted: a step gives fewer links than it has rows (unless ``pairs``, for kernels that
    leave few). Pairs of equal label are joined already and not compared. With ``own`` parts are compared with
    themselves only, which moves each row once; each number deals the rows in another way. ``size`` is what ``parts`` gives, if known.
    """
    dealt = rows.join(parts(rows, block, text) if size is None else size, "cluster")
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id", *([] if own is None else [F.lit(own)])), F.col("_g")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)) if own is None else F.col("_own"))
    dealt = dealt.withColumn("key", F.xxhash64("cluster", F.least("_own", "_other"), F.greatest("_own", "_other"))).withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    dealt = dealt.withColumn("alone", F.col("_own") == F.col("_other"))
    rest = [c for c in rows.columns if c not in ("cluster", "id", "label")]
    dealt = dealt.select("key", "side", "alone", "id", "label", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "key"):
            t = pa.Table.from_batches(held).combine_chunks()
            side = t.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            whole = t.to_batches()[0]
            one, two = whole.slice(0, cut), whole.slice(cut)
            if not whole.column(2)[0].as_py() and not (one.num_rows and two.num_rows):
                continue
            if whole.column(2)[0].as_py():
                two = one = whole
            labels = [x.column(4).to_numpy() for x in (one, two)]
            other = labels[0][:, None] != labels[1][None, :]
            if not other.any():
                continue
            linked = kernel(one, two) & other
            if pairs:
                i, j = np.nonzero(linked)
                a, b = one.column(3).to_numpy()[i], two.column(3).to_numpy()[j]
                a, b = np.maximum(a, b), np.minimum(a, b)
            else:  # labels join their holders already: links are between labels
                a, b = spanning(*labels, linked)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "a long, b long")


def stars(members: DataFrame) -> DataFrame:
    """(key, id) -> written (key, id, center) of the keys that several ids share: center is one of them, mostly the least.

    Rows are range-sorted by key and id, so that a key shared by very many ids spreads over partitions, each of which
    has its least id as center; the centers of such a key are members of the least one's star. One shuffle; a center
    stands in its own star. Partitions are streamed, no group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = center = None
        told = True  # whether the star of the last key has its center's row
        edges: list[tuple[int, int]] = []

        def out(k: np.ndarray, i: np.ndarray, c: np.ndarray, edge: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x) for x in (k, i, c, np.full(len(k), edge))], ["key", "id", "center", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (batch.column(j).to_numpy() for j in (0, 1))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            goes_on = keys[0] == key
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            heads = ids[start].copy()
            if goes_on:
                heads[0] = center
            elif not edges:
                edges.append((int(keys[0]), int(ids[0])))
            member = ids != heads[group]
            tell = np.bincount(group[member], minlength=len(start)) > 0
            if goes_on and told:
                tell[0] = False
            k = np.concatenate([keys[start][tell], keys[member]])
            yield out(k, np.concatenate([heads[tell], ids[member]]), np.concatenate([heads[tell], heads[group[member]]]), False)
            told = bool(tell[-1]) or (told and goes_on and len(start) == 1)
            key, center = int(keys[-1]), int(heads[-1])
        if key is not None:
            edges.append((key, center))
            k, c = np.array(sorted(set(edges)), np.int64).T
            yield out(k, c, c, True)

    dealt = members.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = written(dealt.mapInArrow(run, "key long, id long, center long, edge boolean"), "stars")
    # keys that cross the bounds of partitions: at most two centers from each partition
    edge = found.where("edge").select("key", "center").distinct()
    least = edge.groupBy("key").agg(F.min("center").alias("least"), F.count("*").alias("parts")).where("parts > 1")
    across = written(edge.join(least, "key").select("key", F.col("center").alias("id"), F.col("least").alias("center")), "stars")
    out = written(found.where("not edge").select("key", "id", "center").union(across), "stars")
    discard(found, across)
    return out


def classes(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], by_bucket: bool = False) -> DataFrame:
    """(node, component) of ids that some chain of verified links joins; ids without a link are left out.

    ``shared`` holds the stars (key, id, center) of ids that share a key and so may be linked. First each is compared
    with its center only: ``verify`` takes distinct pairs (a, b) and keeps those that are links. Buckets whose
    members then all stand in one class are done. The members of the others, joined into clusters by the
    buckets they share, go to ``settle`` as (cluster, id, label), which returns links (a, b) between labels that
    join whatever is linked; so no class is torn, and a bucket of many alike is never expanded. With ``by_bucket``
    each of these buckets is a cluster of its own: ids that share no bucket are then not compared.
    """
    pairs = shared.where("id != center").select(F.greatest("id", "center").alias("a"), F.least("id", "center").alias("b")).distinct()
    links = written(verify(pairs).select("a", "b"), "links")
    found = components(links)
    label = found.toDF("id", "label")
    wide = shared.select("key", "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = wide.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("id").alias("low"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids")).where("l0 != l1 and n > 2")
    mixed = mixed.groupBy("low", "n", "ids").agg(F.min("key").alias("key")).select("key", "low")  # equal buckets once
    rest = written(wide.join(mixed, "key").select("key", "id", "label", "low").distinct(), "mixed")
    if rest.isEmpty():
        discard(links, rest)
        return found
    if by_bucket:
        clusters = rest.select(F.col("key").alias("cluster"), "id", "label")
    else:
        cluster = components(rest.select(F.col("id").alias("a"), F.col("low").alias("b")))
        clusters = rest.select("id", "label").distinct().join(cluster.toDF("id", "cluster"), "id").select("cluster", "id", "label")
    more = written(settle(clusters), "links")
    out = components(found.toDF("a", "b").union(more))
    discard(links, rest, more, found, *([] if by_bucket else [cluster]))
    return out
