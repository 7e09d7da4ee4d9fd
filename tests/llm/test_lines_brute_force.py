"""Fuzzy lines of a whole table against brute-force edit distances."""

import os
import re

import numpy as np
import pytest

from rootgraph.llm import lines

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(line):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.translate(LOWER)).strip(" ")


def reaches(a, b, most):
    """Whether the edit distance is ``most`` at most: the table row by row, given up when a whole row is beyond."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    step = np.arange(len(y) + 1)
    row = step
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return False
    return row[-1] <= most


def similar_pairs(texts):
    """All pairs (i < j) of edit similarity 0.8; lengths and letter counts are bounds from below."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
    count = np.zeros((len(texts), len(letters)), np.int32)
    for i, t in enumerate(texts):
        np.add.at(count[i], [letters[c] for c in t], 1)
    size = np.array([len(t) for t in texts])
    out = []
    for i in range(len(texts)):
        most = np.floor(0.2 * np.maximum(size[i], size[i + 1 :]) + 1e-9).astype(int)
        near = np.flatnonzero(np.abs(size[i] - size[i + 1 :]) <= most)
        apart = count[i + 1 + near] - count[i]
        near = near[np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= most[near]]
        out += [(i, i + 1 + j) for j in near.tolist() if reaches(texts[i], texts[i + 1 + j], most[j])]
    return out


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the driver's tables")
def test_recall_over_a_table(spark):
    """Of all pairs of lines that brute force finds alike the later goes in nine of ten at least, and nothing else goes."""
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    first, places = {}, []
    for d, text in sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None and r.doc_id is not None):
        for pos, line in enumerate(text.split("\n")):
            if t := plain(line):
                first.setdefault(t, (d, pos))
                places.append((t, (d, pos)))
    gone = {(r.doc_id, p) for r in lines.duplicate_lines(docs).collect() for p in r["at"]}
    assert all(at in gone for t, at in places if first[t] != at)  # equal lines
    texts = list(first)  # by place
    pairs = similar_pairs(texts)
    found = sum(first[texts[j]] in gone for _, j in pairs)
    print(f"lines {len(texts)}, pairs {len(pairs)}, found {found}")
    assert len(pairs) > 20 and found >= 0.9 * len(pairs)
    assert {t for t in texts if first[t] in gone} <= {texts[j] for _, j in pairs} | chained(texts, pairs)


def chained(texts, pairs):
    """Lines that are not the first of their class."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return {t for i, t in enumerate(texts) if root(i) != i}


def test_scattered_digits(spark):
    """Lines of one template whose digits differ everywhere: what chains of brute-force pairs join goes, over several parts of a bucket."""
    rng = np.random.default_rng(11)
    number = lambda: "".join(map(str, rng.integers(0, 10, 6)))
    texts = list(dict.fromkeys(f"Order {number()} of customer {number()} was shipped on day {number()} and paid" for _ in range(1500)))
    apart = ["Order of customer was returned on a day and never paid", "A line 12 of another kind 99"]
    rows = list(enumerate(texts + apart))
    letters = np.array([list(t.encode()) for t in texts], np.uint8)
    # replaced letters alone: a lower bound of what the rule joins
    label = np.arange(len(texts))
    near = [np.flatnonzero((letters != row).sum(axis=1) <= int(0.2 * len(row) + 1e-9)) for row in letters]
    while any((label[n].min() < label[i]) for i, n in enumerate(near)):
        label = np.array([label[n].min() for n in near])
    want = {i for i in range(len(texts)) if label[i] != i}
    gone = {r.doc_id for r in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 1400 and want <= gone <= set(range(1, len(texts)))


def test_digitless_forms():
    """Runs of digits count as one, also next to the bounds of lines, and lines without digits have none."""
    texts = ["in 1987 it was 5", "in 7 it was 123456", "7", "77", "no digits", "x1", "1x"]
    plain = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    form, digits = lines.digitless(plain, np.cumsum(size) - size, size)
    assert form[0] == form[1] and form[2] == form[3] and len(set(form.tolist())) == 5
    assert digits.tolist() == [5, 7, 1, 2, 0, 1, 1]
