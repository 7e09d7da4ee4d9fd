"""Operator 11: document fingerprints of closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootgraph.llm.common import fresh, pin, ranked, table

#: tokens of a k-mer and of the substrings inside it; a k-mer is an anchor if its least substring is its first or its last,
#: which of k - s + 1 substrings holds for 2 in k - s + 1
K, S = 5, 2
#: blocks of scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han (fixed values)
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: a token: a run of letters, marks and digits, cut after 16; one character of a script without spaces; any other visible character
TOKEN = rf"[a-zA-Z0-9\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]{{1,16}}+|\S"
#: documents in a block; one block is one group of a window
BLOCK = 64


def with_anchors(rows: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """Adds ``name``: the anchors (pos, hash) of a text, in text order; pos is the token a k-mer starts at.

    Whether a k-mer is taken depends on its own tokens only, so a passage keeps its anchors wherever it stands. Any
    k - s k-mers in a row hold an anchor. A text of fewer tokens than k, but not none, or without an anchor, has one
    anchor of all its tokens. Null is empty and has none.
    """
    if not 0 < s < k:
        raise ValueError("an inner substring is shorter than its k-mer and not empty")
    token, inner = fresh(rows.withColumn(name, F.lit(None)), "tokens", "inner")
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    rows = rows.select("*", pin(words).alias(token))
    at = lambda array, i, n: [F.get(F.col(array), i + j) for j in range(n)]
    rows = rows.select("*", pin(F.transform(F.col(token), lambda x, i: F.xxhash64(*at(token, i, s)))).alias(inner))
    n = F.size(token)

    def edge(x: Column, i: Column) -> Column:
        *between, last = at(inner, i + 1, k - s)
        low = F.least(*between) if len(between) > 1 else between[0] if between else None
        return (i <= n - k) if low is None else (i <= n - k) & (F.least(x, last) <= low)

    found = F.filter(F.transform(F.col(inner), lambda x, i: F.when(edge(x, i), F.struct(i.cast("int").alias("pos"), F.xxhash64(*at(token, i, k)).alias("hash")))), lambda a: a.isNotNull())
    rows = rows.select("*", pin(found).alias(name))
    whole = F.when(n > 0, F.array(F.struct(F.lit(0).alias("pos"), F.aggregate(token, F.lit(0).cast("long"), lambda h, x: F.xxhash64(h, x)).alias("hash")))).otherwise(F.col(name))
    return rows.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole)).drop(token, inner)


def written_out(anchors: Column) -> Column:
    """Anchors as text: position and hexadecimal hash of each, parted by spaces."""
    return F.lower(F.array_join(F.transform(anchors, lambda a: F.concat(a["pos"].cast("string"), F.lit(":"), F.hex(a["hash"]))), " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two lists of anchors; 1 if both are empty."""
    x, y = a["hash"], b["hash"]
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, anchors, fingerprint) of every whole text, a row a row. Null and empty texts have no anchor; repeated
    rows are answered each; an empty table gives no rows; other columns are ignored."""
    rows = with_anchors(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "anchors", k, s)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "anchors", written_out(F.col("anchors")).alias("fingerprint"))


def with_next(docs: DataFrame, k: int = K, s: int = S, block: int = BLOCK) -> DataFrame:
    """doc_id, text, anchors, and text and anchors of the next document (next_text, next_anchors): the next in ascending
    doc_id, after the last the first.

    Rows are range-sorted once, so ranks cost no window over the table; ``block`` documents of consecutive rank and the
    one that follows them then form a group, whatever the ids and texts are.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    rows = ranked(rows.withColumn("tie", F.xxhash64("text")), [], ["doc_id", "tie"], "at").drop("tie")
    own = F.floor(F.col("at") / block).cast("long")
    place = lambda of, at, guest: F.struct(of.alias("block"), at.alias("at"), F.lit(guest).alias("guest"))
    at = F.col("at").cast("long")
    guest = F.when(at == 0, F.array(place(F.lit(max(0, total - 1) // block).cast("long"), F.lit(total).cast("long"), True))).when(at % block == 0, F.array(place(own - 1, at, True))).otherwise(F.array().cast("array<struct<block:bigint,at:bigint,guest:boolean>>"))
    dealt = rows.select("doc_id", "text", F.explode(F.concat(F.array(place(own, at, False)), guest)).alias("p")).select("doc_id", "text", "p.*")
    dealt = with_anchors(dealt.repartition("block"), "text", "anchors", k, s)
    order = Window.partitionBy("block").orderBy("at")
    return dealt.select("doc_id", "text", "anchors", "guest", F.lead("text").over(order).alias("next_text"), F.lead("anchors").over(order).alias("next_anchors")).where("not guest").drop("guest")


def edited(docs: DataFrame, k: int = K, s: int = S, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last quarter (rounded down, in code points) is replaced
    by as many of the first characters of the next document, or all it has.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: likeness to the edited
    text and to the next document. Null and empty texts are alike: 0 characters, an empty fingerprint, likeness 1 to each
    other and 0 to any other. The next of a lone document is itself. Rows of one id follow each other in the order of a
    hash of their texts; null ids come first. Long texts are read whole, in one task; an empty table gives no rows; other
    columns are ignored.
    """
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, s, block)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    other = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "anchors", likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"), pin(other).alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors", k, s)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("anchors")).alias("fingerprint"),
        written_out(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        "near_next",
    )


def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
