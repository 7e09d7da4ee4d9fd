"""Documents of very many entities and terms: the pairs that can disclose are found, the others never meet."""

import math
from collections import Counter

from rootgraph.llm import privacy


def test_thousands_of_entities_and_words(spark):
    mail = lambda i: f"user{i}@example.org"
    texts = [" ".join([mail(i) for i in range(1500)] + [f"word{i}" for i in range(4000)])]
    texts += [" ".join([mail(i) for i in range(k, 1500, 40)] + [f"word{i}" for i in range(k % 7, 4000, 7)] + ["common words here"]) for k in range(60)]
    texts += [f"common words here word{i} only" for i in range(0, 300, 3)] + ["nothing", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held, words = {}, {}
    for i, t in enumerate(texts):
        parts = (t or "").split()
        held[i] = {f"email:{p}" for p in parts if "@" in p}
        words[i] = {w for p in parts for w in p.replace("@", " ").replace(".", " ").lower().split() if len(w) > 1}
    d_e, d_t = Counter(e for s in held.values() for e in s), Counter(w for s in words.values() for w in s)
    d_et = Counter((e, w) for i, s in held.items() for e in s if d_e[e] >= 2 for w in words[i])
    n = len(texts)
    over = {p for p, c in d_et.items() if c >= 2 and math.log(n * c / (d_e[p[0]] * d_t[p[1]])) >= privacy.DISCLOSURE * math.log(n / d_e[p[0]])}
    by_entity = {}
    for e, w in over:
        by_entity.setdefault(e, set()).add(w)
    want = {i: {w for e in s for w in by_entity.get(e, ()) if w in words[i]} for i, s in held.items()}
    found = privacy.entities(docs)
    got = {}
    for r in privacy.disclosing(found, docs, privacy.DISCLOSURE, 2).select("doc_id", "term").distinct().collect():
        got.setdefault(r.doc_id, set()).add(r.term)
    assert got == {i: s for i, s in want.items() if s} and len(over) > 1000
    assert privacy.sanitise(docs).count() == n
