"""Operator 2: near-duplicate documents by DartMinHash signatures and banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.buckets import classes, in_blocks, stars
from rootgraph.llm.common import discard, table, written
from rootgraph.llm.kernels import U64, lists, mix, pieces, prefix_hash, ragged, shingles, span_hash, words

WIDTH, THRESHOLD = 5, 0.8
#: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32, about 3 in a million
BANDS, ROWS = 32, 5
#: heights at which the rank axis below 1 is cut; above 1 each unit is a region
_LEVELS = np.array([0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1])
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a region, scaled to 2^64."""
    p, out, total = np.exp(-area), [], 0.0
    for k in range(24):
        total += p
        out.append(min(total, 1 - 2**-53))
        p *= area / (k + 1)
    return (np.array(out) * 2.0**64).astype(U64)


def occurrences(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements sorted by (doc, hash) with the ordinal of each among its equals: unit cells of the weight axis."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return d, x, np.arange(len(d)) - np.repeat(at, np.diff(np.append(at, len(d))))


def darts(doc: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, area: float, salt: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throws each region's darts and keeps the earliest (rank, mark) for each document and coordinate in ``out``.

    A region is a unit of an element's weight times the ranks low to high; how many darts it holds, and where,
    depends on the element and region alone, so that documents which share it share its darts.
    """
    seed = mix(cell ^ (salt * U64(0xD6E8FEB86659FD93)))
    number = np.searchsorted(_poisson(area), seed, "right")
    hit = np.flatnonzero(number)
    n = number[hit]
    row = np.repeat(hit, n)
    dart = mix(seed[row] + (ragged(n).astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    rank = low[row] + (high[row] - low[row]) * ((dart >> U64(11)).astype(np.float64) * 2.0**-53)
    mark = mix(dart)
    packed = ((rank * 2.0**26).astype(U64) << U64(24)) | (mark & U64(0xFFFFFF))
    np.minimum.at(out, doc[row] * k + ((mark >> U64(24)) % U64(k)).astype(np.int64), packed)


def signatures(h: np.ndarray, count: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash of each document's shingle multiset: k coordinates, equal with probability the weighted Jaccard.

    About k ln k + 2k darts are thrown for a document whatever its weight: the rank up to which regions are
    opened is chosen from the total weight and doubled for documents with a coordinate still empty.
    """
    doc, element, copy = occurrences(np.repeat(np.arange(len(count)), count), h)
    cell = mix(element + copy.astype(U64) * U64(0xA0761D6478BD642F))
    out = np.full(len(count) * k, _EMPTY)
    top = (k * np.log(k) + 2 * k) / np.maximum(1, count)
    done = np.zeros(len(count))
    todo = count > 0
    while todo.any():
        for lo, hi in zip(_LEVELS[:-1], _LEVELS[1:], strict=True):
            use = todo & (lo < top) & (done <= lo)
            if use.any():
                at = np.flatnonzero(use[doc])
                full = np.ones(len(at))
                darts(doc[at], cell[at], full * lo, full * hi, hi - lo, np.full(len(at), int(hi * 16), U64), k, out)
                done[use] = hi
        more = np.where(todo & (done >= 1), np.maximum(0, np.ceil(top) - done), 0).astype(np.int64)
        step = np.minimum(more, 64)
        while step.any():
            each = step[doc]
            at, level = np.repeat(np.arange(len(doc)), each), ragged(each)
            low = done[doc[at]] + level
            for i in range(0, len(at), 1 << 20):
                j = slice(i, i + (1 << 20))
                darts(doc[at[j]], cell[at[j]], low[j], low[j] + 1, 1.0, (low[j] + 16).astype(U64), k, out)
            done += step
            more -= step
            step = np.minimum(more, 64)
        todo &= (out.reshape(-1, k) == _EMPTY).any(axis=1)
        top = np.where(todo, np.maximum(top, done) * 2, top)
    return out.reshape(-1, k)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    s = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(s.shape[1], dtype=U64), s.shape[:2]) * U64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key ^ s[:, :, r])
    return key


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, f1, f2 (hash of the word sequence, or of a wordless text), n (shingles; null for null), bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches):
            h, first, last = words(data, start, end)
            sh, count = shingles(h, first, last, WIDTH)
            key = bands(signatures(sh, count)).view(np.int64)
            some = count > 0
            raw = span_hash(prefix_hash(data), start, end)  # tells wordless texts apart
            f = [np.where(some, span_hash(prefix_hash(x), first, last), mix(raw ^ U64(k))).view(np.int64) for k, x in enumerate((h, mix(h ^ U64(0x5851F42D4C957F2D))), 1)]
            known = np.asarray(batch.column(1).is_valid())
            yield pa.record_batch([batch.column(0), pa.array(f[0]), pa.array(f[1]), pa.array(count, pa.int64(), mask=~known), lists(key[some].reshape(-1), np.where(some, BANDS, 0), pa.int64())], ["doc_id", "f1", "f2", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f1 long, f2 long, n long, bands array<long>")


def similarity(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b, ta, tb), the pairs whose weighted Jaccard of word shingles reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column(2), batch.column(3)])
            size = batch.num_rows
            step = max(1, min(size, int(size * (4 << 20) / max(1, batch.nbytes))))
            keep = np.zeros(size, bool)
            for i in range(0, size, step):
                j = min(i + step, size)
                half = pa.record_batch([pa.concat_arrays([both.slice(i, j - i), both.slice(size + i, j - i)])], ["text"])
                hs, counts = [], []
                for _, data, start, end in pieces(iter([half])):
                    sh, count = shingles(*words(data, start, end), WIDTH)
                    hs.append(sh)
                    counts.append(count)
                h, count = np.concatenate(hs), np.concatenate(counts)
                doc, x, copy = occurrences(np.repeat(np.arange(len(count)), count), h)
                pair, cell = doc % (j - i), mix(x + copy.astype(U64) * U64(0xA0761D6478BD642F))
                order = np.lexsort((cell, pair))
                p, c = pair[order], cell[order]
                inner = np.bincount(p[1:][(p[1:] == p[:-1]) & (c[1:] == c[:-1])], minlength=j - i)
                outer = count[: j - i] + count[j - i :] - inner
                keep[i:j] = inner >= threshold * outer
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def cells(rows: DataFrame) -> DataFrame:
    """Replaces text by the cells (element and copy) of its shingle multiset, which two texts share as they do elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches):
            sh, count = shingles(*words(data, start, end), WIDTH)
            _, x, copy = occurrences(np.repeat(np.arange(len(count)), count), sh)
            found = lists(mix(x + copy.astype(U64) * U64(0xA0761D6478BD642F)).view(np.int64), count, pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), found], ["cluster", "id", "label", "cells"])

    return rows.mapInArrow(run, "cluster long, id long, label long, cells array<long>")


def block_links(x: pa.RecordBatch, y: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Which rows of x and y reach the threshold, exactly: shared cells are counted by products of incidence matrices."""
    held = [b.column(b.schema.get_field_index("cells")) for b in (x, y)]
    size = [np.diff(h.offsets.to_numpy()) for h in held]
    flat = [h.flatten().to_numpy() for h in held]
    row = [np.repeat(np.arange(len(n)), n) for n in size]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    shared = np.zeros((len(size[0]), len(size[1])), np.float32)
    place, inside = [], []
    for f in flat:
        at = np.minimum(np.searchsorted(both, f), max(0, len(both) - 1))
        place.append(at)
        inside.append(both[at] == f if len(both) else np.zeros(len(f), bool))
    for lo in range(0, len(both), 8192):
        m = []
        for k in (0, 1):
            use = inside[k] & (place[k] >= lo) & (place[k] < lo + 8192)
            dense = np.zeros((len(size[k]), min(8192, len(both) - lo)), np.float32)
            dense[row[k][use], place[k][use] - lo] = 1
            m.append(dense)
        shared += m[0] @ m[1].T
    return shared >= threshold * (size[0][:, None] + size[1][None, :] - shared) - 1e-6


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents joined by chains of weighted Jaccard similarity of five-word shingles >= ``threshold``.

    Texts of equal word sequence are merged first; the others meet in bands of their DartMinHash signatures, and
    every link is verified on the whole texts. Returns doc_id, n_shingles, class_id (the smallest id of the class),
    kept (one row of each class). A text of fewer than five words, but not none, is one shingle. Empty and wordless
    texts have no shingles and are alike only if equal; a null text (null shingles) is a class of its own, as is
    a row with a null id. Ids are taken as unique; rows repeated with their id are one document. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(sign(docs), "signed")
    some = signed.where("n is not null and doc_id is not null")
    texts = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    weight = texts.select("rep", "n")
    shared = stars(texts.select(F.explode("bands").alias("key"), F.col("rep").alias("id")))
    kept = docs.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    kept = written(kept, "compared")

    def verify(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(weight.toDF("a", "na"), "a").join(weight.toDF("b", "nb"), "b")
        sized = sized.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b")
        return similarity(sized.join(kept.toDF("a", "ta"), "a").join(kept.toDF("b", "tb"), "b"), threshold)

    def settle(rows: DataFrame) -> DataFrame:
        return in_blocks(cells(rows.join(kept.withColumnRenamed("doc_id", "id"), "id").select("cluster", "id", "label", "text")), lambda x, y: block_links(x, y, threshold))

    found = classes(shared, verify, settle)
    discard(shared, kept)
    named = texts.select("f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("class_id"))
    named = written(named, "named")
    discard(texts, found)
    out = some.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "n", "class_id")
    rest = signed.where("n is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("class_id"))
    return out.union(rest).select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
