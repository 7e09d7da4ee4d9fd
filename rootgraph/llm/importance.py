"""Operator 12: importance resampling towards a target distribution, on n-gram buckets from combined CRCs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import ranked, table, written
from rootgraph.llm.kernels import lower_words, pieces

BUCKETS, MAX_N = 10_000, 1
#: a document takes part in the draw from this many words on; this share of those is drawn, in per cent
MIN_WORDS, PERCENT = 20, 10
SEED = 2024
#: the generator polynomial of CRC-32, bits reversed (a fixed value)
POLYNOMIAL = 0xEDB88320
#: words up to this many bytes are summed side by side, longer ones one by one
SHORT = 32
U32 = np.uint32


def _byte_table() -> np.ndarray:
    """The CRC register after one byte, for each byte."""
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), (c >> U32(1)) ^ U32(POLYNOMIAL), c >> U32(1))
    return c


def _times(matrix: list[int], vector: int) -> int:
    """A 32 x 32 matrix over GF(2), given by the images of the unit vectors, times a vector."""
    out = 0
    for image in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= image
        vector >>= 1
    return out


class Shift:
    """Multiplies CRCs by the matrix of n zero bytes, n given for each: the step that appends what follows.

    crc(a + b) = M^len(b) crc(a) xor crc(b), where M stands for one zero byte. The powers M^(2^j) come by squaring and
    are kept as four tables of 256 entries each, so that one product is four look-ups.
    """

    def __init__(self) -> None:
        one = _byte_table()
        self.matrix = [int(one[1 << b]) if b < 8 else 1 << (b - 8) for b in range(32)]
        self.tables: list[np.ndarray] = []

    def table(self, j: int) -> np.ndarray:
        while len(self.tables) <= j:
            t = np.zeros((4, 256), U32)
            for k in range(4):
                for b in range(8):
                    t[k, 1 << b : 2 << b] = t[k, : 1 << b] ^ U32(self.matrix[8 * k + b])
            self.tables.append(t)
            self.matrix = [_times(self.matrix, image) for image in self.matrix]
        return self.tables[j]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        crc = crc.copy()
        for j in range(int(n.max(initial=0)).bit_length()):
            at = np.flatnonzero((n >> j) & 1)
            t, c = self.table(j), crc[at]
            crc[at] = t[0][c & U32(255)] ^ t[1][(c >> U32(8)) & U32(255)] ^ t[2][(c >> U32(16)) & U32(255)] ^ t[3][c >> U32(24)]
        return crc


_BYTE = _byte_table()
_shift = Shift()


def word_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of low[start:end] for each word."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, U32)
    order = np.argsort(size, kind="stable")
    brief = int(np.searchsorted(size[order], SHORT, "right"))
    at = order[:brief]
    for k in range(int(size[at].max(initial=0))):
        at = at[np.searchsorted(size[at], k, "right") :]  # those with a byte k, still in order of size
        c = out[at]
        out[at] = _BYTE[(c ^ low[start[at] + k]) & U32(255)] ^ (c >> U32(8))
    out ^= U32(0xFFFFFFFF)
    for i in order[brief:]:
        out[i] = zlib.crc32(low[start[i] : end[i]])
    return out


def gram_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, rows) of all runs of 1, 2, ... ``max_n`` words of a row, joined by one space.

    Each word is summed once; a run is its predecessor, shifted by the length of a space and the next word, plus those.
    """
    word = word_crcs(low, start, end)
    size = end - start
    yield word, row
    if max_n < 2:
        return
    spaced = _shift(np.full(len(word), zlib.crc32(b" "), U32), size) ^ word
    crc, at = word, np.arange(len(word))
    for n in range(2, max_n + 1):
        on = np.flatnonzero(at + n <= len(row))
        on = on[row[at[on]] == row[at[on] + n - 1]]
        crc, at = crc[on], at[on]
        crc = _shift(crc, size[at + n - 1] + 1) ^ spaced[at + n - 1]
        yield crc, row[at]


def bucket_counts(texts: DataFrame, buckets: int, max_n: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, start, end in pieces(batches):
            low, ws, we, row = lower_words(data, start, end)
            for crc, _ in gram_crcs(low, ws, we, row, max_n):
                total += np.bincount(crc % U32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its share in the target over that in the source, add-one smoothed, as whole numbers."""
    s, t, b = int(source.sum()), int(target.sum()), len(source)
    of = lambda x, y: math.floor(1000 * math.log(float(y + 1) * float(s + b) / (float(x + 1) * float(t + b))))
    return np.array([of(x, y) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draws the documents whose words look most like the target's, without replacement, by Gumbel top-k.

    Features are all runs of 1 to ``max_n`` words, hashed into ``buckets``; both tables are counted whole. A document's
    weight is the sum of its features' gains; a Gumbel variate from a hash of seed and id is added, and of the documents
    with at least ``min_words`` words the highest ``percent`` per cent are drawn, ties to the smaller id. Returns, for
    each row, doc_id, n_features, weight, score and rank (from 1; null if not drawn).

    Null, empty and wordless texts have no features, weight 0, and are never drawn (if ``min_words`` is above 0); an empty
    target weighs by the source alone; an empty table gives no rows. Repeated rows are ranked each; a null id is hashed as
    empty and comes before others of its score. Very long texts are counted whole; other columns are ignored.
    Counts reach the driver as one number a bucket. Ranks come from a range sort of the scores, never from one task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(docs.select("text"), buckets, max_n), bucket_counts(target.select(F.col(target_col).alias("text")), buckets, max_n))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches):
            low, ws, we, row = lower_words(data, start, end)
            n, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for crc, at in gram_crcs(low, ws, we, row, max_n):
                held = np.bincount(at, minlength=len(start))
                edge = np.concatenate([[0], np.cumsum(held)])
                sums = np.concatenate([[0], np.cumsum(gain[crc % U32(buckets)])])
                n += held
                total += sums[edge[1:]] - sums[edge[:-1]]
            yield pa.record_batch([batch.column(0), pa.array(np.bincount(row, minlength=len(start)), pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") < min_words).alias("out"))
    placed = ranked(written(scored, "scored"), [], ["out", F.col("score").desc(), "doc_id"], "at")
    drawn = percent * placed.where("not out").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS MATERIALIZED (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
v AS MATERIALIZED (
  SELECT w, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::UBIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM sc) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tc) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket)),
wt AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
