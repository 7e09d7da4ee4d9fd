"""Operator 6: language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootgraph.llm.common import table
from rootgraph.llm.kernels import lists, pieces

#: dimensions of a vector; letter classes (0 is the gap between words); labelled texts learned from in each language
DIM, CLASSES, PER_LANGUAGE = 1024, 64, 4000
UNKNOWN = "und"

_classes: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """For each code point: a-z are 1 to 26, other letters are spread over 27 to 63 by their lower case, all else is 0."""
    if not _classes:
        lut = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if (ch := chr(cp)).isalpha():
                low = ord(ch.lower()[0])
                lut[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _classes["lut"] = lut
    return _classes["lut"]


def letter_vectors(dim: int = DIM) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each letter class."""
    return np.random.default_rng(20240601).choice(np.array([-1, 1], np.int8), (CLASSES, dim))


def gram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letter vectors, permuted (rotated) by their place, bound by multiplication into a vector for each trigram."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[codes // CLASSES**2] * second[codes // CLASSES % CLASSES] * letters[codes % CLASSES]).astype(np.float32)


def bundles(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of its trigrams' vectors, and how many trigrams it has; trigrams see one word and its gaps."""
    try:
        cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first, last = at[start], at[end]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(start, end, strict=True)]
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        last = np.cumsum([len(t) for t in texts])
        first = last - [len(t) for t in texts]
    c = letter_classes()[cps]
    edge = np.zeros(len(c) + 1, bool)
    edge[first] = edge[last] = True
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:] = np.where(edge[1:-1], 0, c[:-1])
    after[:-1] = np.where(edge[1:-1], 0, c[1:])
    spot = np.flatnonzero(c)
    code = (before[spot] * CLASSES + c[spot]) * CLASSES + after[spot]
    lo, hi = np.searchsorted(spot, first), np.searchsorted(spot, last)
    seen = np.bincount(code, minlength=CLASSES**3) > 0
    used = np.flatnonzero(seen)
    column = np.cumsum(seen) - 1
    out = np.zeros((len(start), letters.shape[1]), np.float32)
    if len(used):
        vectors = gram_vectors(used, letters)
        step = max(1, (4 << 20) // len(used))
        place = column[code]
        for i in range(0, len(start), step):
            j = min(i + step, len(start))
            row = np.repeat(np.arange(j - i), hi[i:j] - lo[i:j])
            counts = np.bincount(row * len(used) + place[lo[i] : hi[j - 1]], minlength=(j - i) * len(used))
            out[i:j] = counts.reshape(j - i, -1).astype(np.float32) @ vectors
    return out, hi - lo


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Language names and prototypes: sums of unit bundles of up to about ``per_language`` labelled texts of each.

    ``docs`` holds doc_id, text, lang. Only rows that are not held out are read. Texts with a letter are chosen by a
    hash of id and text, so copies are drawn one by one, at a rate that makes about that many of each language; the
    row of the least hash is always among them. What returns to the driver is one vector a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False)))
    known = known.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    rates = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("rate"), F.min("h").alias("low"))
    chosen = known.join(F.broadcast(rates), "lang").where((F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30)) | (F.col("h") == F.col("low")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_vectors(dim), {}
        for batch, data, start, end in pieces(batches):
            b, n = bundles(data, start, end, letters)
            b = np.rint(1000 * b / np.maximum(1e-9, np.sqrt((b * b).mean(axis=1, keepdims=True)))).astype(np.int64)  # whole numbers: sums in any order agree
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs[n > 0]):
                total[lang] = total.get(lang, 0) + b[(langs == lang) & (n > 0)].sum(axis=0)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), lists(np.concatenate(list(total.values())), np.full(len(total), dim), pa.int64())], ["lang", "vec"])

    sums = chosen.select("text", "lang").mapInArrow(add, "lang string, vec array<long>")
    sums = sums.select("lang", F.posexplode("vec").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        found.setdefault(r.lang, np.zeros(dim))[r.at] = r.v
    names = sorted(found)
    return names, np.array([found[x] / max(1e-9, np.linalg.norm(found[x])) for x in names]).reshape(-1, dim)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs``, row by row, with the prototype of highest cosine, after taking out what all share, and its score."""
    spark = docs.sparkSession
    middle = prototypes.mean(axis=0) if len(names) > 1 else np.zeros(prototypes.shape[1])
    profile = prototypes - middle
    profile = profile / np.maximum(1e-12, np.sqrt((profile * profile).sum(axis=1, keepdims=True)))
    model = spark.sparkContext.broadcast((names, middle.astype(np.float32), profile.astype(np.float32)))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, middle, profile = model.value
        letters = letter_vectors(len(middle))
        for batch, data, start, end in pieces(batches, text_col):
            b, n = bundles(data, start, end, letters)
            b = b / np.maximum(1e-9, np.sqrt((b * b).sum(axis=1, keepdims=True))) - middle
            cos = b @ profile.T / np.maximum(1e-9, np.sqrt((b * b).sum(axis=1, keepdims=True))) if names else np.zeros((len(b), 1))
            best = cos.argmax(axis=1)
            some = n > 0 if names else np.zeros(len(n), bool)
            pred = np.where(some, np.array(names or [UNKNOWN], object)[best], UNKNOWN)
            score = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *out])

    return docs.mapInArrow(guess, T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))


def with_language(docs: DataFrame, out: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, row by row, with the predicted language and its score in two more columns, whose names are free (see ``language_ids``)."""
    names, prototypes = learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    return identify(docs, names, prototypes, text_col, out)


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicts every row's language from its whole text; returns doc_id, held_out, lang_pred, score.

    Learns from rows with a language that are not held out (see ``learn``). A text that is null or has no letter
    is ``und`` with score 0, as is every text when nothing could be learned. A null id counts as not held out.
    Repeated rows are each answered; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names, prototypes = learn(docs)
    out = identify(docs.select("doc_id", "text"), names, prototypes)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))
