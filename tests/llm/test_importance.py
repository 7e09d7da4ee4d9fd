"""Combined CRCs against zlib, and importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from rootgraph.llm import importance
from rootgraph.llm.kernels import lower_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, max_n):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)


def test_runs_have_the_crc_of_their_text():
    texts = ["One two THREE", "", "é" * 40 + " b " + "long" * 300, "...", "a b c d e f g h", "ünder_scored 漢字 x1"]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    low, ws, we, row = lower_words(np.frombuffer(data, np.uint8), starts, ends)
    for n, (crc, at) in enumerate(importance.gram_crcs(low, ws, we, row, 4), 1):
        want = []
        for r, t in enumerate(texts):
            w = WORD.findall(t.translate(LOWER))
            want += [(zlib.crc32(" ".join(w[i : i + n]).encode()), r) for i in range(len(w) - n + 1)]
        assert list(zip(crc.tolist(), at.tolist(), strict=True)) == want
    none = np.zeros(0, np.int64)
    assert [len(c) for c, _ in importance.gram_crcs(low, none, none, none, 3)] == [0, 0, 0]


def by_hand(rows, target, buckets, max_n, min_words, percent, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for g in grams(text, max_n)[0]:
            s[bucket(g)] += 1
    for text in target:
        for g in grams(text, max_n)[0]:
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        g, words = grams(text, max_n)
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= min_words])
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = ranked[: len(ranked) * percent // 100]
    return sorted(((*r[:4], next((k for k, d in enumerate(drawn, 1) if d is r), None)) for r in out), key=repr)


def test_draw_is_as_by_hand(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = docs.where("doc_id in (9, 10)").union(docs.where("text is null")).select("text")
    texts = [r.text for r in target.collect()]
    for buckets, max_n, min_words, percent in ((10_000, 1, 20, 50), (97, 3, 1, 100), (50, 2, 0, 30)):
        got = importance.resample(docs, target, buckets, max_n, min_words, percent, 7)
        got = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        want = by_hand(rows, texts, buckets, max_n, min_words, percent, 7)
        # rows that are equal but for their rank may take either rank
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert sorted((g[4] for g in got if g[4]), key=int) == list(range(1, 1 + sum(w[4] is not None for w in want)))
        assert {(g[0], g[3]) for g in got if g[4]} == {(w[0], w[3]) for w in want if w[4]}
    assert importance.resample(none, target).count() == 0
    assert importance.resample(docs, target.where("false")).where("rank is not null").count() == 0  # four of the rows have 20 words
    assert importance.resample(docs.withColumn("at", F.lit(1)).withColumn("out", F.lit("x")), target, percent=100).where("rank is not null").count() > 3
