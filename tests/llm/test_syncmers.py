"""Closed syncmers against a plain version over a whole table, and awkward rows."""

import hashlib
import os

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from rootgraph.llm import syncmers

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
UNSPACED = regex.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
LETTER = regex.compile(r"[\p{L}\p{M}\p{N}]")


def tokens(text):
    out, run = [], ""
    for c in text + " ":
        joins = bool(LETTER.match(c)) and not UNSPACED.match(c)
        if run and (not joins or len(run) == 16):
            out.append(run)
            run = ""
        if joins:
            run += c
        elif c not in " \t\n\r\f\v":
            out.append(c)
    return out


def spark_hash(values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def anchors(text, k, s):
    t = [spark_hash([x]) for x in tokens(text or "")]
    inner = [spark_hash(t[i : i + s]) for i in range(len(t) - s + 1)]
    found = []
    for i in range(len(t) - k + 1):
        held = inner[i : i + k - s + 1]
        if min(held) in (held[0], held[-1]):
            found.append((i, spark_hash(t[i : i + k])))
    if not found and t:
        h = 0
        for x in t:
            h = spark_hash([h, x])
        found = [(0, h)]
    return found


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def shown(found):
    return " ".join(f"{p}:{h & (1 << 64) - 1:x}" for p, h in found)


def compare(rows, got, k=syncmers.K, s=syncmers.S):
    """rows: (id, text) in order; got: collected result."""
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = anchors(text, k, s), anchors(edited, k, s), anchors(after, k, s)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), jaccard(a, b), jaccard(a, c))
        mine = [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in by[i]]
        assert any(m[:4] == want[:4] and m[4:] == pytest.approx(want[4:]) for m in mine), i


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the driver's tables")
def test_whole_table_is_as_by_hand(spark):
    docs = spark.read.parquet(DOCUMENTS)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = syncmers.op11_closed_syncmers(spark, os.path.dirname(DOCUMENTS)).collect()
    compare(rows, got)
    equal = {}
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert equal.setdefault(text, r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 100]
    assert sum(r.near_edited > r.near_next for r in long) == len(long)


def test_awkward_rows(docs, none):
    got = syncmers.edited(docs).collect()
    assert len(got) == docs.count()
    ordered = [r for r in docs.select("doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("doc_id", "h").collect()]
    compare([(r.doc_id, r.text) for r in ordered], got)
    assert syncmers.edited(none).count() == 0
    assert syncmers.fingerprints(none).count() == 0


def test_scripts_ties_and_small_blocks(spark):
    texts = ["漢字かな混じりの文章です。" * 5, "नमस्ते दुनिया " * 9, "x" * 500, "same same same same same same same same", "😀" * 40, "a b", " \n\t ", "tail"]
    rows = list(enumerate(texts * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, s, block in ((5, 2, 3), (8, 3, 64), (3, 1, 1)):
        compare(rows, syncmers.edited(docs, k, s, block).collect(), k, s)
    one = syncmers.edited(docs.where("doc_id = 3")).first()
    assert one.near_next == 1.0
    with pytest.raises(ValueError):
        syncmers.fingerprints(docs, 3, 3)


def test_a_passage_keeps_its_anchors(spark):
    passage = " ".join(f"word{i * i % 97}" for i in range(60))
    docs = spark.createDataFrame([(0, passage), (1, "other beginning here, " + passage + " and another end")], "doc_id long, text string")
    a, b = ({x.hash: x.pos for x in r.anchors} for r in syncmers.fingerprints(docs).orderBy("doc_id").collect())
    assert set(a) <= set(b) and len(a) > 15
    assert {b[h] - a[h] for h in a} == {4}
