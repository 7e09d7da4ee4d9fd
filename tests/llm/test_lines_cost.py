"""Fuzzy lines: edit distances within a band, and what is written and moved."""

import numpy as np

from rootgraph.llm import lines


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, letters, text, times):
    text = list(text)
    for _ in range(times):
        k = int(rng.integers(0, len(text)))
        text[k : k + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
        text = text or ["a"]
    return "".join(text)


def test_distances_within_a_band():
    """Distances up to the limit are those of plain edit distance, larger ones are beyond it, whatever the band leaves out."""
    rng = np.random.default_rng(1)
    letters = list("abcdeé字 ")
    beyond = 0
    for size in (1, 5, 63, 64, 65, 128, 130, 200, 260):
        for most in (0, size // 10, size // 5, size // 2):
            texts = ["".join(rng.choice(letters, size)) for _ in range(6)]
            pairs = [(t, edited(rng, letters, t, int(rng.integers(0, 2 + size // 3)))) for t in texts]
            pairs = [(a, b) for a, b in pairs + [(b, a) for a, b in pairs] if abs(len(a) - len(b)) <= most]
            if not pairs:
                continue
            want = np.array([plain(a, b) for a, b in pairs])
            beyond += (want > most).sum()
            for got in (lines.distances(pairs, most), np.array([lines.limited(a, b, most) for a, b in pairs])):
                assert ((got == want) | ((want > most) & (got > most))).all()
    assert beyond > 20


def test_only_mixed_lines_move(spark, monkeypatch):
    """Lines' keys are not written for every copy, and lines of settled buckets are left out when mixed buckets are compared."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), 6))
    rows = []
    for i in range(60):  # pairs, settled at once
        words = [word() for _ in range(20)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], word()]))]
    base = [word() for _ in range(20)]
    for i in range(6):  # near misses: half of the words are shared
        rows.append((1000 + i, " ".join(base[:13] + [word() for _ in range(7)])))
    sizes = {}

    def held(df, name, write=lines.written):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "written", held)
    gone = {r.doc_id for r in lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {2 * i + 1 for i in range(60)}
    assert "scanned" not in sizes and sizes["distinct"] == [126]
    assert sizes["mixed-lines"] and max(sizes["mixed-lines"]) <= 6 < 100 < sizes["compared"][0]
