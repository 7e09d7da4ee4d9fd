"""Operator 7: personal data and the terms that reveal it, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import table, written

#: Patterns of the kinds, written so that matching takes linear time: a run is entered at its start, or where the last
#: match ended, and is never given back, which finds the same matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: a term reveals an entity if its information on it is at least this share of the entity's own, and documents where both must stand together
DISCLOSURE, TOGETHER = 0.9, 2
TERM = r"[\p{L}\p{N}]+"
#: terms beyond every bound that are dropped before a join, the most frequent first
FREQUENT = 10_000
GENERAL = {"number": "NUMBER", "word": ""}


def spans_of(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """Array of (start, end, value) of the pattern's matches, leftmost and non-overlapping, in code points, if ``keep``.

    Cutting the text at the matches gives the lengths between them, whose running sum with those of the matches
    gives their places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.struct(end.alias("at"), F.when(keep(x["value"]), more).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, zero, step)["out"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check that a match of its kind must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(13, 19) & luhn(F.when(F.length(digits).between(13, 19), digits).otherwise(F.lit("1")))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind; texts that cannot hold one are not searched."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]
    return F.when(may, spans_of(text, PATTERNS[kind], lambda v: valid(kind, v))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def terms_of(text: Column) -> Column:
    """Array of the distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, base spans by kind, and the distinct entities they name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    for kind in PATTERNS:
        out = out.withColumn(kind, base_spans(F.col("text"), kind))
    every = F.concat(*(F.transform(kind, lambda s, k=kind: F.concat(F.lit(f"{k}:"), F.lower(s["value"]))) for kind in PATTERNS))
    return out.select("doc_id", *PATTERNS, F.array_distinct(every).alias("entities"))


def disclosing(found: DataFrame, docs: DataFrame, share: float, together: int) -> DataFrame:
    """(doc_id, start, end, term) of every occurrence of a term, in each document that holds an entity of which it tells
    more than the threshold allows.

    With N documents, an entity e in df(e) of them carries log(N / df(e)); a term t that stands in df(e, t) of these and
    in df(t) documents in all gives log(N df(e, t) / (df(e) df(t))) of that away. All counts are of documents, over
    whole texts. As df(e, t) is df(e) at most, a term can disclose e only if df(t) <= N^(1 - share) df(e)^share, so terms are
    counted first and only those within that bound meet the entities of their documents. Pairs are summed before they
    move, and keyed by entity and term, so a hot entity is spread over its terms.
    """
    n = docs.count()
    held = found.select("doc_id", F.explode("entities").alias("entity")).distinct()
    of_entity = written(held.groupBy("entity").agg(F.count("*").alias("d_e")).where(F.col("d_e").between(together, n - 1)), "counts")
    bound = lambda d: F.pow(F.lit(float(max(n, 1))), 1 - share) * F.pow(d.cast("double"), share) * (1 + 1e-9)
    most = of_entity.agg(bound(F.max("d_e"))).first()[0] or 0.0
    # an entity of too few documents has no pair that counts
    held = held.join(of_entity, "entity").groupBy("doc_id").agg(F.collect_set(F.struct("entity", "d_e")).alias("entities"))
    held = written(held, "held")
    terms = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).where(F.length("term") > 1)
    terms = written(terms.groupBy("term").agg(F.count("*").alias("d_t")).where(F.col("d_t") >= together), "terms")
    # the most frequent of the terms beyond the bound are dropped where they stand; the rest fall away in the join
    frequent = terms.where(F.col("d_t") > most).orderBy(F.col("d_t").desc(), "term").limit(FREQUENT).select("term")
    whole = docs.where("text is not null").join(held.select("doc_id"), "doc_id").select("doc_id", F.explode(terms_of(F.col("text"))).alias("term"))
    whole = whole.where(F.length("term") > 1).join(F.broadcast(frequent), "term", "left_anti").join(terms.where(F.col("d_t") <= most), "term")
    whole = written(whole.groupBy("doc_id").agg(F.collect_set(F.struct("term", "d_t")).alias("terms")).join(held, "doc_id"), "whole")
    each = whole.select("doc_id", "terms", F.explode("entities").alias("e")).select("doc_id", "e.*", F.explode(F.filter("terms", lambda t: t["d_t"] <= bound(F.col("e.d_e")))).alias("t")).select("doc_id", "entity", "d_e", "t.*")
    pair = each.groupBy("entity", "term").agg(F.count("*").alias("d_et"), F.first("d_e").alias("d_e"), F.first("d_t").alias("d_t")).where(F.col("d_et") >= together)
    told = F.log(F.lit(float(n)) * F.col("d_et") / (F.col("d_e") * F.greatest("d_t", "d_et")))
    over = written(pair.where(told >= share * F.log(F.lit(float(n)) / F.col("d_e"))).select("entity", "term"), "over")
    gone = each.join(over, ["entity", "term"]).groupBy("doc_id").agg(F.collect_set("term").alias("gone"))
    spans = spans_of(F.col("text"), TERM, lambda v: F.array_contains("gone", F.lower(v)))
    out = docs.where("text is not null").join(gone, "doc_id").select("doc_id", F.explode(spans).alias("t"))
    return out.select("doc_id", "t.start", "t.end", F.lower("t.value").alias("term")).distinct()


def sanitise(docs: DataFrame, share: float = DISCLOSURE, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds personal data in every whole text, and the terms in it, wherever they stand, that reveal it.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and terms: an array of (start, end, term,
    replacement) where a term with a digit is generalised to NUMBER and any other is removed. Null and empty texts
    have no spans. Ids are taken as unique; a repeated row gets the same spans. Rows with a null id get their base
    spans only. With one document, or an entity in all of them, no term reveals anything. An empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(entities(docs), "entities")
    terms = disclosing(found.where("doc_id is not null"), docs, share, together)
    kind = "array<struct<start:int,end:int,term:string>>"
    terms = terms.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "term"))).cast(kind).alias("more"))
    out = found.drop("entities").join(terms, "doc_id", "left").withColumn("more", F.coalesce("more", F.array().cast(kind)))
    # terms inside an entity are covered by it
    base = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in PATTERNS))
    out = out.withColumn("base", base).withColumn("more", F.filter("more", lambda t: ~F.exists("base", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))))
    texts = F.concat(*(listed(k, F.col(k)) for k in PATTERNS))
    replaced = F.transform("more", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["term"].alias("term"), F.when(t["term"].rlike("[0-9]"), F.lit(GENERAL["number"])).otherwise(F.lit(GENERAL["word"])).alias("replacement")))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(texts, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(texts, listed("term", F.col("more"))), ",").alias("spans"),
        replaced.alias("terms"),
    )


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("terms")
