"""Operators 2, 6, 7 and 8 over a whole table, against plain brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from rootgraph.llm import language, minhash, privacy, sharding

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

pytestmark = pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(DOCUMENTS)


@pytest.fixture(scope="module")
def rows(table):
    return table.collect()


def cells(text):
    """The multiset of five-word shingles as a set of (shingle, how often before)."""
    words = WORD.findall(text.translate(LOWER))
    seen, out = Counter(), set()
    for i in range(max(1, len(words) - 4) if words else 0):
        gram = tuple(words[i : i + 5])
        out.add((gram, seen[gram]))
        seen[gram] += 1
    return out


def test_near_duplicates_are_those_of_all_pairs(table, rows):
    known = {r.doc_id: cells(r.text) for r in rows if r.text is not None}
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    wordless, links, ids = {}, 0, sorted(known, key=lambda d: len(known[d]))
    for r in rows:
        if r.text is not None and not known[r.doc_id]:
            a, b = sorted((root(r.doc_id), root(wordless.setdefault(r.text, r.doc_id))))
            parent[b] = a
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = known[i], known[j]
            if not a or len(a) < 0.8 * len(b):
                break
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y], links = x, links + 1
    got = {r.doc_id: r for r in minhash.near_duplicates(table).collect()}
    assert links > 20
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in parent}
    assert all(r.kept == (root(i) == i) for i, r in got.items())
    assert all(r.n_shingles == (len(known[i]) if i in known else None) for i, r in got.items())


def bundle(text, letters, classes):
    """The sum of a text's trigram vectors, one letter at a time."""
    c = [0, *(int(classes[ord(x)]) for x in text), 0]
    out = np.zeros(letters.shape[1])
    for (a, b, d), n in Counter(t for t in zip(c, c[1:], c[2:], strict=False) if t[1]).items():
        out += n * (np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[d])
    return out


def test_language_is_the_nearest_prototype(table, rows):
    letters, classes = language.letter_vectors().astype(float), language.letter_classes()
    of = {r.doc_id: bundle(r.text or "", letters, classes) for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    unit = lambda v: v / max(1e-12, np.linalg.norm(v))
    total = defaultdict(lambda: np.zeros(language.DIM))
    for r in rows:
        if r.lang is not None and not held[r.doc_id] and of[r.doc_id].any():
            total[r.lang] += unit(of[r.doc_id])
    names = sorted(total)
    prototypes = np.array([unit(total[n]) for n in names])
    middle = prototypes.mean(axis=0)
    profile = np.array([unit(p - middle) for p in prototypes])
    got = {r.doc_id: r for r in language.language_ids(table).collect()}
    right = tried = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == held[r.doc_id] and 0 <= g.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        cos = profile @ unit(unit(of[r.doc_id]) - middle)
        first, second = np.sort(cos)[::-1][:2]
        assert abs(g.score - np.clip(first, 0, 1)) < 1e-3
        assert first - second < 1e-3 or g.lang_pred == names[int(cos.argmax())]
        if held[r.doc_id] and r.lang is not None:
            tried, right = tried + 1, right + (g.lang_pred == r.lang)
    assert tried > 100 and right >= 0.97 * tried


def test_language_does_not_look_at_the_answer(table):
    """Labels of held-out rows, sources and other columns change nothing."""
    blind = table.withColumn("lang", F.when(~language.held_out("doc_id"), F.col("lang"))).withColumn("source", F.lit("x"))
    assert language.language_ids(table).exceptAll(language.language_ids(blind)).count() == 0


def luhn(digits):
    twice = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def base(text):
    """kind -> [(start, end, value)] by the contract's patterns."""
    out = {k: [] for k in BASE}
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out[kind].append((m.start(), m.end(), m.group()))
    return out


def test_personal_data_and_disclosing_terms(table, rows):
    found = {r.doc_id: base(r.text or "") for r in rows}
    words = {r.doc_id: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", r.text or "")] for r in rows}
    held = {d: {f"{k}:{v.lower()}" for k, spans in f.items() for _, _, v in spans} for d, f in found.items()}
    terms = {d: {t for _, _, t in w} for d, w in words.items()}
    d_e = Counter(e for x in held.values() for e in x)
    d_t = Counter(t for x in terms.values() for t in x)
    d_et = Counter((e, t) for d, x in held.items() for e in x if d_e[e] >= privacy.TOGETHER for t in terms[d] if len(t) > 1)
    n, over, close = len(rows), set(), set()
    for (e, t), c in d_et.items():
        if c >= privacy.TOGETHER and d_e[e] < n:
            told, needed = math.log(n * c / (d_e[e] * d_t[t])), privacy.DISCLOSURE * math.log(n / d_e[e])
            if abs(told - needed) < 1e-9:
                close.add(t)
            elif told > needed:
                over.add((e, t))
    got = {r.doc_id: r for r in privacy.sanitise(table).collect()}
    assert len(got) == len(rows) and sum(d_e.values()) > 20
    for d, f in found.items():
        listed = [f"{k}:{a}:{b}" for k in BASE for a, b, _ in f[k]]
        g = got[d]
        assert [g[f"n_{k}"] for k in BASE] == [len(f[k]) for k in BASE]
        assert g.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        inside = [(a, b) for k in BASE for a, b, _ in f[k]]
        gone = {t for e in held[d] for t in terms[d] if (e, t) in over}
        want = {(a, b, t) for a, b, t in words[d] if t in gone and not any(a < y and x < b for x, y in inside)}
        assert {(t.start, t.end, t.term) for t in g.terms if t.term not in close} == {w for w in want if w[2] not in close}
        assert g.spans == ",".join(listed + [f"term:{t.start}:{t.end}" for t in g.terms])


def least_capacity(sizes, shards):
    """The least largest sum of at most ``shards`` runs, by dynamic programming over all cuts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends.copy()
    for _ in range(shards - 1):
        best = np.array([0] + [np.maximum(best[:i], ends[i] - ends[:i]).min() for i in range(1, len(ends))])
    return int(best[-1])


def test_shards_have_the_least_capacity(table):
    got = sharding.shard_documents(table, 8).collect()
    order = {r.doc_id: r.k for r in table.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    group, shards = Counter(), defaultdict(list)
    for r in got:
        group[order[r.doc_id]] += r["size"]
        shards[r.shard].append(r)
    assert max(sum(r["size"] for r in s) for s in shards.values()) == least_capacity([group[k] for k in sorted(group)], 8)
    seen = -math.inf
    for s in sorted(shards):
        assert sorted(r.slot for r in shards[s]) == list(range(len(shards[s])))
        keys = [order[r.doc_id] for r in shards[s]]
        assert min(keys) > seen  # runs of whole groups
        seen = max(keys)
    assert len(got) == len(order)
