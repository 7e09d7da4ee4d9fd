"""Each operator on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootgraph.llm import common, decontaminate, embeddings, language, lines, minhash, packing, privacy, sharding, suffixes, warc
from rootgraph.llm.common import components


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (33, 31), (5, 0), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == dict.fromkeys(range(21), 0) | {30: 30, 31: 30, 33: 30}
    assert components(links.where("a < 0")).count() == 0


def test_warc(spark, tmp_path):
    html = "<p>" + "x" * 200
    rows = [(1, "http://a", html), (2, "http://b\nInjected: 1", html), (3, None, None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (1, "http://a", html), (None, "u", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    sums = set()
    for k in (1, 5):
        root = f"file://{tmp_path}/{k}"
        files = warc.write_warc(pages.repartition(k), root, shard_bytes=300, roll=400)
        sums.add(tuple(sorted((r.file, r.sha256) for r in files.collect())))
    assert len(sums) == 1  # the same bytes however the rows are dealt
    got = warc.read_warc(spark, root, payloads=True).collect()
    assert len(got) == len(rows)
    assert Counter((r.record_type, r.refers_to) for r in got) == {("response", None): 5, ("revisit", 1): 3}
    assert {r.page_id: r.payload_bytes for r in got}[3] == 0
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    root = f"file://{tmp_path}/none"
    warc.write_warc(pages.where("false"), root)
    assert warc.read_warc(spark, root).count() == 0


def test_minhash(docs, none):
    got = by_id(minhash.near_duplicates(docs))
    assert [got[i].class_id for i in range(12)] == [0, 0, 0, 3, 4, 4, 6, 7, 8, 9, 10, 11]
    assert got[None].kept and got[3].kept and not got[1].kept
    assert minhash.near_duplicates(docs).count() == docs.count()
    assert minhash.near_duplicates(none).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    other = np.concatenate([base[:250], rng.integers(1, 1 << 60, 40).astype(np.uint64), base[:30]])
    s = minhash.signatures(np.concatenate([base, other]), np.array([300, 320]), 2000)
    a, b = Counter(base.tolist()), Counter(other.tolist())
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    one = minhash.signatures(np.array([7], np.uint64), np.array([1, 0]), 160)
    assert (one[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_lines(docs, none):
    out = lines.dedup_lines(docs)
    got = by_id(out)
    assert set(docs.columns) <= set(out.columns)
    assert got[10].text == "line of plain text\n" and got[10].n_removed == 1
    assert got[2].text == "" and got[0].n_removed == 0
    assert got[3].text is None and got[3].n_lines == 0 and got[None].n_removed == 0
    assert lines.dedup_lines(none).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_recall_of_edit_similarity(spark):
    """Of lines with one word replaced, nearly all that brute force finds alike go; no others do."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(3, 9)))
    rows, alike = [], set()
    for i in range(120):
        words = [word() for _ in range((5, 8, 12, 25, 60)[i % 5])]
        other = list(words)
        other[rng.integers(len(other))] = word()
        a, b = " ".join(words), " ".join(other)
        rows += [(i, a), (1000 + i, b)]
        if 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.8:
            alike.add(1000 + i)
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {r.doc_id for r in out.where("n_removed > 0").collect()}
    assert len(alike) > 90 and gone <= alike
    assert len(gone) >= 0.97 * len(alike)


def test_lines_that_differ_in_digits(spark):
    """Digits count in equality and in edit similarity."""
    texts = ["1987", "2024", "12 40 77 31 58", "93 26 10 84 67", "In 1987 it was", "In 2024 it was", "row 12 40", "Row 12, 40"]
    got = by_id(lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].n_removed for i in range(8)] == [0, 0, 0, 0, 0, 0, 0, 1]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    odd = docs.union(docs.sparkSession.createDataFrame([(50, "It's <|endoftext|> don't--stop 'twas É́x 12ab İx   y", *[None] * 7)], docs.schema))
    rows = packing.pack(odd).collect()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.update((r.doc_id, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert packing.pack(none).count() == 0


def test_suffixes(docs, none):
    got = by_id(suffixes.remove_repeats(docs))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen: set[bytes] = set()
    for d in sorted(k for k in texts if k is not None):
        b = texts[d]
        gone = np.zeros(len(b), bool)
        mine = [b[i : i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(mine):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(mine)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[d].n_removed, got[d].kept, got[d].kept_sha256) == (int(gone.sum()), kept, hashlib.sha256(kept).hexdigest())
    assert got[None].n_removed == 0
    assert suffixes.remove_repeats(none).count() == 0


BIG = (1 << 53) + 1


def test_null_ids_beside_large_ones(spark):
    """Ids above 2^53 stay exact where a null id stands in the same column."""
    text = "a passage that stands in every one of these documents and is longer than fifty bytes"
    rows = [(BIG + i, f"{i} {text} {i}") for i in range(40)] + [(None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(suffixes.remove_repeats(docs))
    assert got[BIG].n_removed == got[None].n_removed == 0
    assert all(got[BIG + i].n_removed >= len(text) + 2 for i in range(1, 40))
    pages = spark.createDataFrame([(BIG + i, "u", "<p>" + "x" * 200) for i in range(40)] + [(None, "u", "tiny")], "page_id long, url string, html string")
    root = f"{common.new_path(spark, 'warc')}"
    warc.write_warc(pages.repartition(3), root, shard_bytes=2000)
    got = by_id(warc.read_warc(spark, root), "page_id")
    assert got[BIG].record_type == "response" and got[None].record_type == "response"
    assert all((got[BIG + i].record_type, got[BIG + i].refers_to) == ("revisit", BIG) for i in range(1, 40))


def test_warc_rolls_by_default(spark):
    rng = np.random.default_rng(3)
    pages = spark.createDataFrame([(i, "u", rng.bytes(1 << 20).hex()) for i in range(12)], "page_id long, url string, html string")
    root = common.new_path(spark, "warc")
    files = warc.write_warc(pages, root).collect()
    assert len(files) > len({r.shard for r in files}) and all(r.bytes <= warc.ROLL_BYTES for r in files)
    assert warc.read_warc(spark, root).count() == 12


def test_language(docs, none):
    got = by_id(language.language_ids(docs))
    assert {got[i].lang_pred for i in (3, 4, 6)} == {"und"}
    assert got[8].lang_pred in ("en", "fr")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert language.language_ids(none).count() == 0


def test_language_learned_from_copies(spark):
    """A language of many copies of one text is learned, whatever the hash of that text."""
    for k in range(6):
        rows = [(i, f"the water of the river runs number {'abcdefgh'[i % 8]}", "en") for i in range(200)]
        rows += [(1000 + i, f"der Fluss und das Wasser {'klmnop'[k]}", "de") for i in range(200)] + [(2000 + i, "!!!", "de") for i in range(200)]
        names, _ = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
        assert names == ["de", "en"]


def test_privacy(docs, none):
    got = by_id(privacy.sanitise(docs))
    assert (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 0, 1)
    assert got[9].spans.startswith("email:") and got[3].spans == ""
    spark = docs.sparkSession
    odd = spark.createDataFrame([(0, "a@b.c_d@e.f x"), (1, "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1"), (2, "4111 1111 1111 1111 and 4111 1111 1111 1112"), (3, "+1 (2) 345-678-90 é +12")], "doc_id long, text string")
    got = by_id(privacy.sanitise(odd))
    assert got[0].spans == "email:0:5,email:5:11"
    assert got[1].spans.startswith("ip:0:7,ip:8:15,ip:26:35")
    assert got[2].spans == "card:0:19"
    assert got[3].n_phone == 1
    assert privacy.sanitise(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"Mail to the keeper quillon at q@x.example now {i}") for i in range(3)] + [(10 + i, f"the plain text at now to mail number {i}") for i in range(60)]
    got = by_id(privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    terms = {t.term for t in got[0].terms}
    assert "quillon" in terms and "the" not in terms
    assert not got[12].terms


def test_disclosing_terms_far_away(spark):
    """Terms count, and go, wherever they stand in a document of their entity."""
    far = "the plain text at now " * 30
    rows = [(i, f"Quillon first. {far} mail q@x.example now {far} and Quillon again") for i in range(3)]
    rows += [(3, f"quillon near q@x.example, {far} then quillon far")] + [(10 + i, f"{far} then first near again and mail number {i}") for i in range(60)]
    got = by_id(privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = dict(rows)
    for i in range(4):
        places = [(t.start, t.end) for t in got[i].terms if t.term == "quillon"]
        assert [texts[i][a:b].lower() for a, b in places] == ["quillon"] * 2
        assert "the" not in {t.term for t in got[i].terms}
    assert not got[12].terms


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    where = {}
    for r in rows:
        t = texts[r.doc_id]
        assert where.setdefault(t, r.shard) == r.shard
        assert (r["size"], r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sharding.shard_documents(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.02 * rng.normal(size=(20, 16)), base[:5]])
    rows = [(i, [float(v) for v in r], i % 2 if i < 60 else (i - 60) % 20 % 2 if i < 80 else (i - 80) % 2) for i, r in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0], 1), (104, rows[0][1], None), (105, [], 1)]
    got = by_id(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows[:85]])[:, None] == np.array([r[2] for r in rows[:85]])[None, :])
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(85)] == linked.sum(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(100, 106))
    assert got[80].component_id == 0 and not got[80].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, BENCH), (2, "one"), (3, None), (None, "!!"), (2, "one")], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, bench))
    assert got[7].n_hit == 1 and got[7].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert got[0].contaminated and got[0].n_hit == 12
    assert not got[3].contaminated and got[8].n_hit == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.where("false")).collect())


BENCH = "word1 stone1 river word2 stone2 river WORD3 stone3, river word4 stone4 river"


@pytest.mark.parametrize("k", [160])
def test_bands_of_equal_texts_agree(k):
    h = np.arange(1, 50, dtype=np.uint64)
    s = minhash.signatures(np.concatenate([h, h[::-1]]), np.array([49, 49]), k)
    assert (s[0] == s[1]).all()
