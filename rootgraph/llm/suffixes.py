"""Operator 5: removal of repeated passages by two-stage suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.buckets import by_key
from rootgraph.llm.common import table, written
from rootgraph.llm.kernels import U64, mix, pieces, prefix_hash, ragged, span_hash

#: bytes of a repeated string, of the grams whose least hash says where a string is dealt, and of text dealt at once
LENGTH, GRAM, FLUSH = 50, 14, 8 << 20
#: compression of dealt strings
LEVEL = 3
#: bytes of dealt strings in a bucket, of text in a shard of the result, and of strings sorted at once
BUCKET_BYTES, SHARD_BYTES, SORT_BYTES = 16 << 20, 16 << 20, 1 << 20


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that compares as they do; past the end stand zeros."""
    pad = np.concatenate([t, np.zeros(LENGTH + 24, np.uint8)])
    out = np.zeros(len(pad) - 7, U64)
    for k in range(8):
        out = (out << U64(8)) | pad[k : len(pad) - 7 + k]
    return out


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Start positions of all suffixes of ``t``, sorted by their first ``depth`` bytes at least.

    Two stages: suffixes smaller than their successor are sorted directly; the others are induced by one scan
    of the buckets of first bytes in rising order, each sorted suffix placing the one before it at the head of
    its bucket's free room. (Ties deeper than ``depth`` stand in any order, which no use here can see.)
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    run_end = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    falls = np.append(t[run_end[:-1]] > t[run_end[:-1] + 1], True)  # the last suffix is larger than the empty one
    larger = np.repeat(falls, np.diff(run_end, prepend=-1))
    word = words_at(t)
    small = np.flatnonzero(~larger)
    order = small[np.argsort(word[small], kind="stable")]
    key = word[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(order) else order
    for at in range(8, depth + 7, 8):
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        if not len(tied):
            break
        part = order[tied]
        key = word[np.minimum(part + at, len(word) - 1)]
        by = np.lexsort((key, group[tied]))
        order[tied], key = part[by], key[by]
        new = np.zeros(len(order), bool)
        new[tied[1:]] = key[1:] != key[:-1]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | new[1:]]))
    first = np.searchsorted(t[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else order[:0]
        bucket = []
        while len(level):  # longer runs of the byte follow shorter ones
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(t[before] == byte)]
        bucket.append(order[first[byte] : first[byte + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[t[before] > byte]
        before = before[np.argsort(t[before], kind="stable")]
        ends = np.searchsorted(t[before], np.arange(257))
        for b in np.unique(t[before]):
            waiting[b].append(before[ends[b] : ends[b + 1]])
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix but the first, whether it shares ``length`` bytes with the one before it."""
    word = words_at(t)
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        key = word[order + at]
        same &= key[1:] == key[:-1]
    return same


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows dealt together: row, first byte, bytes, hash of the least gram, hash of the whole, the gram's place in it.

    A window of LENGTH bytes is dealt by the least hash of its grams, wherever it stands; windows in a row that
    have the same gram in common travel as one string, so each window is in just one.
    """
    n = len(data)
    windows = np.maximum(0, end - start - LENGTH + 1)
    none = np.zeros(0, np.int64)
    if not windows.sum():
        return none, none, none, none.view(U64), none.view(U64), none
    pre = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    value, where = span_hash(pre, at, at + GRAM), at
    span, width = 1, LENGTH - GRAM + 1
    while span < width:  # least gram of the next `span`, the leftmost of equals
        step = min(span, width - span)
        left = value[:-step] <= value[step:]
        value, where = np.where(left, value[:-step], value[step:]), np.where(left, where[:-step], where[step:])
        span += step
    row = np.repeat(np.arange(len(start)), windows)
    p = np.repeat(start, windows) + ragged(windows)
    gram = where[p]
    new = np.ones(len(p), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(p))) + LENGTH - 1
    first = p[head]
    return row[head], first, size, value[first], span_hash(pre, first, first + size), gram[head] - first


def cover_blobs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, shards: int, buckets: int = 1) -> pa.RecordBatch:
    """Removed spans, dealt by document."""
    shard = (mix(doc.view(U64)) % U64(shards)).astype(np.int64)
    order = np.lexsort((lo, doc, shard))
    shard, packed = shard[order], np.stack([doc, lo, hi - lo], axis=1)[order]
    cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    pack = zstandard.ZstdCompressor(level=1)
    blobs = [pack.compress(packed[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.record_batch([pa.array(shard[cut[:-1]], pa.int32()), pa.array(shard[cut[:-1]] % buckets, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "bucket", "blob"])


def collapse(whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of equal strings stand in the smallest document that holds one."""
    order = np.lexsort((doc, whole))
    new = np.ones(len(order), bool)
    new[1:] = whole[order][1:] != whole[order][:-1]
    low = doc[order][new]
    mine = np.empty(len(order), bool)
    mine[order] = doc[order] == low[np.cumsum(new) - 1]
    return mine


def deal(docs: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Every window-bearing string to its bucket, and spans that are known at once to be repeats to their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, lo, n, least, whole, gram = (np.concatenate([x[k] for x in held]) for k in range(6))
            text = np.concatenate([x[6] for x in held])
            at = np.concatenate([x[7] for x in held])
            mine = collapse(whole, doc)
            if not mine.all():
                yield cover_blobs(doc[~mine], lo[~mine], (lo + n)[~mine], shards, buckets)
            bucket = (mix(least) % U64(buckets)).astype(np.int64)
            keep = np.flatnonzero(mine)
            keep = keep[np.lexsort((lo[keep], doc[keep], bucket[keep]))]
            cut = np.append(np.flatnonzero(np.diff(bucket[keep], prepend=-1)), len(keep))
            names, blobs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                i = keep[a:b]
                content = text[np.repeat(at[i], n[i]) + ragged(n[i])]
                parts = [np.array([len(i)]), doc[i], lo[i].astype(np.int32), n[i].astype(np.uint8), gram[i].astype(np.uint8), content]
                names.append(int(bucket[i[0]]))
                blobs.append(pack.compress(b"".join(x.tobytes() for x in parts)))
            yield pa.record_batch([pa.array([-1] * len(blobs), pa.int32()), pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "bucket", "blob"])

        for batch, data, start, end in pieces(batches, chunk=1 << 19):
            row, first, n, least, whole, gram = strings(data, start, end)
            if not len(row):
                continue
            ids = batch.column(0).to_numpy()[row]
            held.append((ids, first - start[row], n, least, whole, gram, data, first + size))
            size += len(data)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "shard int, bucket int, blob binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc, lo, n, place of the least gram, start of content, content of a bucket's strings."""
    unpack, out, contents = zstandard.ZstdDecompressor(), [], []
    for blob in blobs:
        raw = unpack.decompress(blob)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        out.append([np.frombuffer(raw, kind, k, at).astype(np.int64) for kind, at in ((np.int64, 8), (np.int32, 8 + 8 * k), (np.uint8, 8 + 12 * k), (np.uint8, 8 + 13 * k))])
        contents.append(np.frombuffer(raw, np.uint8, -1, 8 + 14 * k))
    doc, lo, n, gram = (np.concatenate([x[j] for x in out]) for j in range(4))
    return doc, lo, n, gram, np.cumsum(n) - n, np.concatenate(contents)


def hashes(content: np.ndarray, at: np.ndarray, n: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the least gram and of the whole of each string, a part of the content at a time."""
    least, whole = np.empty(len(at), U64), np.empty(len(at), U64)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SORT_BYTES, "left")))
        part = content[at[a] : at[b - 1] + n[b - 1]]
        pre, first = prefix_hash(part), at[a:b] - at[a]
        whole[a:b] = span_hash(pre, first, first + n[a:b])
        spot = first + gram[a:b]
        least[a:b] = span_hash(pre, spot, spot + GRAM)
        a = b
    return least, whole


def repeats(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's strings: (doc, first byte, past-the-last byte) of the spans that a smaller document holds as well."""
    doc, lo, n, gram, at, content = _unpack(blobs)
    least, whole = hashes(content, at, n, gram)
    order = np.lexsort((doc, whole))
    least, whole, doc, lo, n, at = (x[order] for x in (least, whole, doc, lo, n, at))
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    one = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    late = doc > doc[one][number]
    out = [(doc[late], lo[late], (lo + n)[late])]
    # different strings with the same gram may share windows: sort those, whole grams at a time
    gram = least[one]
    _, code, times = np.unique(gram, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[code] > 1)
    some = some[np.argsort(code[some], kind="stable")]
    first_of = np.flatnonzero(~late)
    first_of = first_of[np.argsort(number[first_of], kind="stable")]  # occurrences in the smallest document, by string
    lists = np.searchsorted(number[first_of], np.arange(len(one) + 1))
    ends = np.cumsum(n[one[some]] + 1)
    edges = np.append(np.flatnonzero(np.diff(code[some], prepend=-1)), len(some))
    a = 0
    while a < len(some):
        limit = (ends[a - 1] if a else 0) + SORT_BYTES
        b = int(np.searchsorted(ends, limit, "right"))
        b = max(int(edges[np.searchsorted(edges, b, "right") - 1]), int(edges[np.searchsorted(edges, a, "right")]))
        s = some[a:b]
        size = n[one[s]]
        base = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.uint8)
        inside = np.repeat(base, size) + ragged(size)
        text[inside] = content[np.repeat(at[one[s]], size) + ragged(size)]
        count = size - LENGTH + 1
        start = np.repeat(base, count) + ragged(count)
        owner = np.full(len(text), -1)
        owner[start] = np.repeat(np.arange(len(s)), count)
        sa = suffix_array(text)
        sa = sa[owner[sa] >= 0]
        new = np.concatenate([[True], ~common_prefixes(text, sa)])
        own = owner[sa]
        d = doc[one[s]][own]
        low = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = d > low
        string, offset = s[own[hit]], sa[hit] - base[own[hit]]
        times_ = lists[string + 1] - lists[string]
        spot = first_of[np.repeat(lists[string], times_) + ragged(times_)]
        begin = lo[spot] + np.repeat(offset, times_)
        out.append((doc[spot], begin, begin + LENGTH))
        a = b
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content: bool = True) -> DataFrame:
    """Removes every byte covered by a 50-byte string that also starts in a row with a smaller id.

    Texts are UTF-8 bytes. Each window is dealt by its least gram to one bucket, in strings of about four times the
    text; equal strings are settled by their hash (64 bits within a gram's bucket), and strings that share a gram
    but differ are suffix-sorted together, adjacent common prefixes giving the classes of equal windows and each
    class's smallest id. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``content``, kept (the bytes left).
    Null and empty texts and those under 50 bytes lose nothing, nor do rows with a null id; a window repeated
    within one id only stays, so repeated rows do not touch each other. Ids are taken as unique otherwise. An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = max(1, -(-4 * total // BUCKET_BYTES)), max(1, -(-total // SHARD_BYTES))
    dealt = deal(docs.where("doc_id is not null"), buckets, shards)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "bucket"):
            known = [r.filter(pc.greater_equal(r.column(0), 0)) for r in rows]  # spans that were clear at once pass by
            yield from (r for r in known if r.num_rows)
            blobs = [x for r in rows for x in r.filter(pc.less(r.column(0), 0)).column(2).to_pylist()]
            doc, lo, hi = repeats(blobs) if blobs else ((), (), ())
            if len(doc):
                yield cover_blobs(doc, lo, hi, shards)

    work = dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    spans = work.mapInArrow(settle, "shard int, bucket int, blob binary")
    spans = written(spans.select("shard", "blob"), "spans")

    @F.pandas_udf("int")
    def shard_of(doc):
        import pandas as pd

        return pd.Series((mix(doc.to_numpy(np.int64).view(U64)) % U64(shards)).astype(np.int32))

    # a column with nulls would reach pandas as floating-point numbers, which large ids do not fit in
    texts = docs.select(shard_of(F.coalesce("doc_id", F.lit(0))).alias("shard"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    both = spans.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob").union(texts)
    both = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table_ = [], np.zeros((0, 3), np.int64)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            blob = batch.column(4)
            found += [np.frombuffer(unpack.decompress(x), np.int64).reshape(-1, 3) for x in blob.drop_null().to_pylist()]
            batch = batch.filter(blob.is_null())
            if not batch.num_rows:
                continue
            if found:
                table_ = np.concatenate(found)
                table_ = table_[np.argsort(table_[:, 0], kind="stable")]
                found = []
            for part, data, start, end in pieces(iter([batch])):
                out = []
                none = part.column(2).is_null().to_pylist()
                for d, void, a, b in zip(part.column(2).fill_null(0).to_numpy().tolist(), none, start.tolist(), end.tolist(), strict=True):
                    lo, hi = (0, 0) if void else np.searchsorted(table_[:, 0], (d, d + 1))
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, table_[lo:hi, 1], 1)
                    np.add.at(edge, table_[lo:hi, 1] + table_[lo:hi, 2], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = data[a:b][~gone].tobytes()
                    out.append((b - a, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: b - a]).sum()), hashlib.sha256(kept).hexdigest(), kept if content else None))
                cols = [part.column(2)] + [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.record_batch(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if content else out.drop("kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), content=False)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > m),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS b FROM c),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < b - 1) AS n_spans FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM g) GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.c, '' ORDER BY x.b) AS kept FROM (SELECT doc_id, b, substr(h, 2 * b + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(0, n)) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM r))) x ANTI JOIN g ON g.doc_id = x.doc_id AND g.b = x.b GROUP BY x.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
