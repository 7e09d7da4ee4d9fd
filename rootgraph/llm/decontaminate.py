"""Operator 10: benchmark decontamination by a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import table, written
from rootgraph.llm.kernels import U64, lists, mix, pieces, prefix_hash, ragged, span_hash, words

WINDOW = 10
#: bytes of benchmark text up to which its index is given to every task; more is joined
BLOCK_BYTES = 16 << 20
#: size of the filter of a join, 2^27 bits or 16 MB, and the bits of a key in it
FILTER_BITS, FILTER_HASHES = 27, 4
#: candidate windows verified at once
STRIDE = 1 << 20


class Probe:
    """Membership of 64-bit hashes in a sorted set, behind a bitmap over their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and each one's place in the set."""
        at = np.flatnonzero(self.bits[(h >> U64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[place] == h[at]
        return at[same], place[same]


class Windows:
    """Distinct windows of a block of items: word hashes (padded), lengths, and the items that hold each."""

    def __init__(self, items: list[tuple[object, str]], width: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        found: dict[bytes, list[int]] = {}
        at = 0
        for batch, data, start, end in pieces(iter([pa.record_batch([texts], ["text"])])):
            h, first, last = words(data, start, end)
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                for i in range(a, max(b - width, a) + 1 if b > a else a):
                    found.setdefault(h[i : min(i + width, b)].tobytes(), []).append(at)
                at += 1
        self.size = np.array([len(w) // 8 for w in found], np.int64)
        self.words = np.zeros((len(found), width), U64)
        for k, w in enumerate(found):
            self.words[k, : len(w) // 8] = np.frombuffer(w, U64)
        held = [sorted(set(x)) for x in found.values()]
        self.item_off = np.cumsum([0, *map(len, held)])
        self.items = np.array([i for x in held for i in x], np.int64)
        self.names = [None if k is None else str(k) for k, _ in items]
        self.vocabulary = np.unique(self.words[np.arange(width)[None, :] < self.size[:, None]])

    def order(self, counts: np.ndarray) -> None:
        """Fixes each window's prefix token, its rarest word in the corpus (ties: smaller hash, then first)."""
        place = np.minimum(np.searchsorted(self.vocabulary, self.words), max(0, len(self.vocabulary) - 1))
        inside = np.arange(self.words.shape[1])[None, :] < self.size[:, None]
        rarity = np.where(inside, counts[place] if len(counts) else 0, np.iinfo(np.int64).max)
        least = rarity.min(axis=1, initial=np.iinfo(np.int64).max)
        key = np.where(rarity == least[:, None], self.words, U64(0xFFFFFFFFFFFFFFFF))
        self.at = np.argmin(key, axis=1)
        token = self.words[np.arange(len(self.words)), self.at]
        self.by_token = np.argsort(token, kind="stable")
        self.tokens, self.token_off = np.unique(token[self.by_token], return_index=True)
        self.token_off = np.append(self.token_off, len(token))
        self.probe = Probe(self.tokens)

    def occurrences(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start word, window) of every occurrence in the words h, row r having words first[r]:last[r]."""
        at, token = self.probe.find(h)
        for lo in range(0, len(at), STRIDE // 8):
            p, t = at[lo : lo + STRIDE // 8], token[lo : lo + STRIDE // 8]
            n = self.token_off[t + 1] - self.token_off[t]
            ends = np.cumsum(n)
            i = 0
            while i < len(p):  # cut again where many windows share a token
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STRIDE, "right")))
                win = self.by_token[np.repeat(self.token_off[t[i:j]], n[i:j]) + ragged(n[i:j])]
                start = np.repeat(p[i:j], n[i:j]) - self.at[win]
                row = np.repeat(np.searchsorted(last, p[i:j], "right"), n[i:j])
                keep = (start >= first[row]) & (start + self.size[win] <= last[row])  # positional and length bounds
                win, start, row = win[keep], start[keep], row[keep]
                for k in range(self.words.shape[1]):
                    inside = k < self.size[win]
                    same = ~inside | (h[np.minimum(start + k, len(h) - 1)] == self.words[win, k])
                    win, start, row = win[same], start[same], row[same]
                yield row, start, win
                i = j


def _corpus_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word hash of the vocabulary occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, total = Probe(vocabulary), np.zeros(len(vocabulary), np.int64)
        for _, data, start, end in pieces(batches):
            total += np.bincount(probe.find(words(data, start, end)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["w", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.w] = r.n
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each document lie inside a window of ``width`` consecutive words of a benchmark item.

    Words of a window are ordered by rarity in the corpus; as the whole window must occur, its prefix is the
    one rarest word, which alone is looked for in the documents; positional and length bounds place the
    window, which is then verified word by word. A benchmark of at most ``most`` bytes of text is one index of bounded
    size that every task gets; a larger one is joined as a table (``joined``).
    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each row of ``docs``.
    Null, empty and wordless texts have no words and are clean; an item of fewer words than ``width``, but
    not none, is one window; null item ids still hit words but are not named. Repeated rows are each
    answered; an empty benchmark hits nothing; other columns are ignored. Words are compared by 64-bit hashes: of n
    different words of the texts and m of the benchmark, any two meet with odds of at most n m / 2^64, and a wrong
    hit needs that for a word whose neighbours are all right.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    out = scanned(docs, items, width) if size <= most else joined(docs, items, width)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def scanned(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_words, n_hit, items) with one index of all items, whose text the caller has measured."""
    index = Windows([(r.item, r.text) for r in items.collect()], width)  # at most ``BLOCK_BYTES`` of text
    shared = None
    if len(index.words):
        index.order(_corpus_counts(docs, index.vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches):
            h, first, last = words(data, start, end)
            edge = np.zeros(len(h) + 1, np.int32)
            named: list[set[str]] = [set() for _ in start]
            if shared is not None:
                index = shared.value
                for row, at, win in index.occurrences(h, first, last):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + index.size[win], -1)
                    for r, w in set(zip(row.tolist(), win.tolist(), strict=True)):
                        named[r].update(x for i in index.items[index.item_off[w] : index.item_off[w + 1]] if (x := index.names[i]) is not None)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            yield pa.record_batch([batch.column(0), pa.array(last - first, pa.int64()), pa.array(hit[last] - hit[first], pa.int64()), pa.array([sorted(x) for x in named], pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>")


def _signed(h: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return lists(h.view(np.int64), count, pa.int64())


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item, words): every window of every item, as word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches):
            h, first, last = words(data, start, end)
            n = last - first
            count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
            at = np.repeat(first, count) + ragged(count)
            size = np.repeat(np.minimum(n, width), count)
            row = np.repeat(np.arange(len(n)), count)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), _signed(h[np.repeat(at, size) + ragged(size)], size)], ["item", "words"])

    return items.mapInArrow(run, "item string, words array<bigint>")


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all word hashes of all texts, summed in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held]), len(word)).astype(np.int64)
            return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for _, data, start, end in pieces(batches):
            held.append(np.unique(words(data, start, end)[0], return_counts=True))
            size += len(held[-1][0])
            if size > STRIDE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """The bits of the filter that belong to each key."""
    return [(mix(keys + U64(k)) >> U64(64 - FILTER_BITS)).astype(np.int64) for k in range(FILTER_HASHES)]


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of 2^FILTER_BITS bits of the column key, whatever its rows; tasks make it slice by slice."""
    slices = 1 << 7
    own = 1 << (FILTER_BITS - 7)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(U64))))
            yield pa.record_batch([pa.array(at // own, pa.int32()), pa.array(at % own, pa.int32())], ["slice", "at"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            s, at = (batch.column(i).to_numpy() for i in (0, 1))
            for k in np.unique(s):
                held.setdefault(int(k), np.zeros(own, bool))[at[s == k]] = True
        for k, b in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())], ["slice", "bits"])

    out = np.zeros((slices, own // 8), np.uint8)
    for r in keys.mapInArrow(bits, "slice int, at int").distinct().repartition(slices, "slice").mapInArrow(part, "slice int, bits binary").collect():  # 2^FILTER_BITS bits
        out[r.slice] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def joined(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_words, n_hit, items) by a join of tables, for benchmarks of any size.

    Each distinct window is keyed by up to three words around its rarest one. Documents are read once: a Bloom filter of a
    fixed size lets through the places whose key may be that of a window, with the words around, and these alone are
    joined with the windows and compared word by word. The filter decides what moves, never the result.
    """
    held = written(_windows(items, width), "windows")
    windows = written(held.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "distinct")
    of_item = written(held.where("item is not null").distinct().join(windows, "words").select("win", "item"), "items")
    each = windows.select("win", F.posexplode("words").alias("at", "word"))
    counts = _word_counts(docs).join(each.select("word").distinct(), "word")
    rare = each.join(counts, "word", "left").groupBy("win").agg(F.min_by("at", F.struct(F.coalesce("n", F.lit(0)), "word", "at")).alias("at"))
    size = F.size("words")
    first = F.greatest(F.lit(0), F.least(F.col("at") - 1, size - 3))
    keyed = windows.join(rare, "win").select("win", "words", first.alias("first"), F.least(size, F.lit(3)).alias("span"))
    keyed = written(keyed.withColumn("key", F.xxhash64(F.slice("words", F.col("first") + 1, F.col("span")))), "keyed")
    spans = [r.span for r in keyed.select("span").distinct().collect()]  # 1, 2 or 3
    kernel_key = _kernel_keys(keyed)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(kernel_key.select("hash")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, data, start, end in pieces(batches):
            h, begin, last = words(data, start, end)
            row = np.repeat(np.arange(len(start)), last - begin)
            pre, at_all, n_all = prefix_hash(h), [], []
            for n in spans:
                at = np.arange(max(0, len(h) - n + 1))
                at = at[at + n <= last[row[at]]]
                hit = np.ones(len(at), bool)
                for p in _places(span_hash(pre, at, at + n)):
                    hit &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
                at_all.append(at[hit])
                n_all.append(np.full(int(hit.sum()), n))
            at, n = np.concatenate([*at_all, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*n_all, np.zeros(0, np.int64)])
            order = np.argsort(row[at], kind="stable") if len(at) else at
            at, n = at[order], n[order]
            lo, hi = np.maximum(at - width, begin[row[at]]), np.minimum(at + width, last[row[at]])
            around = _signed(h[np.repeat(lo, hi - lo) + ragged(hi - lo)], hi - lo)
            place = pa.StructArray.from_arrays([pa.array(at - begin[row[at]], pa.int64()), pa.array(at - lo, pa.int32()), pa.array(n, pa.int32()), around], ["at", "off", "span", "around"])
            off = np.searchsorted(row[at], np.arange(len(start) + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(last - begin, pa.int64()), pa.ListArray.from_arrays(pa.array(off), place)], ["row", "doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = written(rows.mapInArrow(scan, f"row long, doc_id {kind}, n_words long, places array<struct<at:bigint,off:int,span:int,around:array<bigint>>>"), "places")
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    places = places.withColumn("key", F.xxhash64(F.slice("around", F.col("off") + 1, F.col("span"))))
    met = places.join(keyed, ["key", "span"]).withColumn("start", F.col("off") - F.col("first"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + size <= F.size("around"))).where(F.slice("around", F.greatest(F.col("start"), F.lit(0)) + 1, size) == F.col("words"))
    occurs = written(met.select("row", "win", (F.col("at") - F.col("first")).alias("at"), size.alias("size")).distinct(), "occurrences")
    hit = occurs.select("row", "at", "size").distinct().select("row", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = occurs.select("row", "win").distinct().join(of_item, "win").groupBy("row").agg(F.collect_set("item").alias("items"))
    out = rows.drop("places").join(hit, "row", "left").join(named, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _kernel_keys(keyed: DataFrame) -> DataFrame:
    """The keys' words hashed as the scan of documents hashes them: column hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            h = key.flatten().to_numpy(zero_copy_only=False).view(U64)
            size = np.asarray(pc.list_value_length(key)).astype(np.int64)
            end = np.cumsum(size)
            yield pa.record_batch([pa.array(span_hash(prefix_hash(h), end - size, end).view(np.int64))], ["hash"])

    return keyed.select(F.slice("words", F.col("first") + 1, F.col("span")).alias("k")).distinct().mapInArrow(run, "hash bigint")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT c.doc_id, c.i, c.n, w.item_id FROM cand c JOIN win w ON c.n = w.n AND c.s = w.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
