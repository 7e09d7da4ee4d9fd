"""Operator 3: fuzzy line deduplication by keys of character grams and of digitless forms, SimHash and edit similarity."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.buckets import classes, in_blocks, parts, stars
from rootgraph.llm.common import columns, components, discard, fresh, pin, table, written
from rootgraph.llm.kernels import U64, mix, pieces, prefix_hash, ragged, span_hash

#: bytes of text scanned at once: what is made of them fits a cache
PIECE = 1 << 18
#: edit similarity, and bits in which 128-bit SimHashes of grams may differ: unrelated lines differ in about 60
THRESHOLD, RADIUS = 0.8, 44
#: keys of a line: each joins the least of ORDERS hash orders of the GRAM-byte grams, of those that SAMPLE picks by their hash
GRAM, ORDERS, KEYS, SAMPLE = 8, 3, 8, 4
#: lines up to SHORT bytes have few long grams: they get keys of all short ones as well, and their SimHashes may differ in MORE bits more
SHORT, SHORT_GRAM, SHORT_ORDERS, SHORT_KEYS, MORE = 64, 5, 2, 6, 8
#: lines whose digits are at most so many times the edits allowed have one more key: what they are with each run of digits as one 0
DIGITS = 1.5
#: times that the lines of a large bucket are dealt into parts compared with themselves only, before all its parts are compared
ROUNDS = 3
#: letters of pairs whose edit distances are found at once, bytes of their tables, and pairs that make that worth while
CELLS, TABLES, FEW = 1 << 20, 1 << 26, 32
#: pairs of two classes' lines in a block that are worth no ordering, pairs a line beyond which a block compares them itself, and at once
SPARSE, MANY, BATCH = 8, 4, 4096
#: letters of a line up to which the edit distance costs less than the bound from aligned words
PLAIN = 1024
#: letters of two lines beyond which a distance is only compared with its limit
LONG = 8192
#: ASCII letters are alike in both cases, digits stay, other ASCII separates words
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x00:0x30] = _FOLD[0x3A:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0


def normalised(line: Column) -> Column:
    """As the kernel sees a line: ASCII letters lower-cased, each run of ASCII other than letters and digits one space."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def line_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number within the row, first byte, past-the-last byte) of every line; a text without a newline is one line."""
    breaks = np.flatnonzero(data == 10)
    lo, hi = np.searchsorted(breaks, start), np.searchsorted(breaks, end)
    count = hi - lo + 1
    row = np.repeat(np.arange(len(start)), count)
    ends = np.cumsum(count)
    a, b = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    tail = np.ones(len(row), bool)
    tail[ends - 1] = False
    head = np.ones(len(row), bool)
    head[ends - count] = False
    inside = breaks[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])] if len(breaks) else breaks
    a[ends - count], b[ends - 1] = start, end
    a[head], b[tail] = inside + 1, inside
    return row, np.arange(len(row)) - np.repeat(ends - count, count), a, b


def simhash(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit SimHash of runs of hashes: each bit is that of most of them. Eight counters share a machine word."""
    n = last - first
    cut = np.maximum(1, -(-n // 255))  # a counter holds 255 at most
    part = np.repeat(first, cut) + (np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)) * 255
    head = np.cumsum(cut) - cut
    out = np.zeros(len(n), U64)
    pad = np.append(h, U64(0))
    part = np.minimum(part, len(h))
    for k in range(8):
        lanes = (pad >> U64(k)) & U64(0x0101010101010101)
        counts = np.add.reduceat(lanes, part).view(np.uint8).reshape(-1, 8).astype(np.int64)
        most = 2 * np.add.reduceat(counts, head, axis=0) > n[:, None]
        for byte in range(8):
            out |= most[:, byte].astype(U64) << U64(8 * byte + k)
    return out


def grams(plain: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` (at most 8) bytes of the lines, and where each line's begin; a shorter line is one run.

    ``plain`` holds no zeros but eight bytes at its end.
    """
    word = np.ndarray(max(0, len(plain) - 7), "<u8", plain, strides=(1,))
    n = np.maximum(1, size - width + 1)
    at = np.repeat(begin, n) + ragged(n)
    bits = np.repeat(8 * np.minimum(size, width), n).astype(U64)
    return mix(word[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - bits))), np.cumsum(n) - n


def sampled_grams(plain: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``grams``, of the grams that their own hash picks, one in ``sample``; and the lines that have four at least.

    What is picked is alike in all lines, so the least hashes of two lines agree as often as they do among all grams.
    """
    word = np.ndarray(max(0, len(plain) - 7), "<u8", plain, strides=(1,)) & (U64(0xFFFFFFFFFFFFFFFF) >> U64(64 - 8 * width))
    spot = np.flatnonzero((word * U64(0x9E3779B97F4A7C15)) < U64((1 << 64) // sample))
    row = np.searchsorted(begin, spot, "right") - 1
    inside = spot + width <= (begin + size)[row] if len(begin) else np.zeros(0, bool)
    spot, row = spot[inside], row[inside]
    n = np.bincount(row, minlength=len(begin))
    some = np.flatnonzero(n >= 4)
    use = n[row] >= 4
    return mix(word[spot[use]]), np.cumsum(n[some]) - n[some], some


def digitless(plain: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line with every run of digits as one 0 (0 where it has none), and how many digits it has; lines stand one after the other."""
    digit = (plain >= 0x30) & (plain <= 0x39)
    n = np.concatenate([[0], np.cumsum(digit, dtype=np.int32)])
    n = n[begin + size] - n[begin]
    out = np.zeros(len(size), U64)
    some = np.flatnonzero(n)
    if len(some) < len(size):  # most lines have none
        at = np.repeat(begin[some], size[some]) + ragged(size[some])
        plain, digit, size = plain[at], digit[at], size[some]
        begin = np.cumsum(size) - size
    again = digit.copy()
    again[1:] &= digit[:-1]
    again[:1] = False
    again[begin] = False
    at = np.concatenate([[0], np.cumsum(~again)])
    h = span_hash(prefix_hash(np.where(digit, 0x30, plain).astype(np.uint8)[~again]), at[begin], at[begin + size])
    out[some] = mix(h ^ U64(0x2545F4914F6CDD1D))
    return out, n


def least_keys(h: np.ndarray, first: np.ndarray, width: int, orders: int, n: int) -> np.ndarray:
    """n keys a line, each of the least hash in ``orders`` orders: two lines share one with that power of their Jaccard similarity."""
    factor = mix(np.arange(1, orders * n + 1, dtype=U64)) | U64(1)
    out = np.repeat(np.arange(width * n, width * n + n, dtype=U64)[:, None], len(first), axis=1)
    for k in range(n if len(first) else 0):
        for i in range(orders):
            out[k] = mix(out[k] ^ np.minimum.reduceat(h * factor[orders * k + i], first))
    return out


def places(doc: np.ndarray, pos: np.ndarray) -> pa.Array:
    """doc * 2^31 + pos as a decimal, whose order is that of lines in the corpus."""
    wide = np.stack([(doc.view(U64) << U64(31)) | pos.astype(U64), (doc >> 33).view(U64)], axis=1)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(np.ascontiguousarray(wide).tobytes())])


def scan(docs: DataFrame, keyed: bool = True) -> DataFrame:
    """doc_id (not null), text -> a row for each line that is not blank: f1, f2 (hash of the normalised line).

    And its place (doc_id * 2^31 + pos); if ``keyed``, s1, s2 (SimHash), and keys k0, k1, ..., the last that of its digitless form.
    """
    names = [f"k{i}" for i in range(KEYS + SHORT_KEYS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, start, end in pieces(batches, chunk=PIECE):
            row, pos, a, b = line_spans(data, start, end)
            low = _FOLD[data]
            word = low != 0
            edge = np.zeros(len(data) + 1, bool)
            edge[a] = edge[b] = True
            head, tail = word.copy(), word.copy()
            head[1:] &= ~word[:-1] | edge[1:-1]
            tail[:-1] &= ~word[1:] | edge[1:-1]
            ws, we = np.flatnonzero(head), np.flatnonzero(tail) + 1
            h = span_hash(prefix_hash(low), ws, we)
            first, last = np.searchsorted(ws, a), np.searchsorted(ws, b)
            keep = last > first
            row, pos, first, last = row[keep], pos[keep], first[keep], last[keep]
            other = mix(h ^ U64(0x5851F42D4C957F2D))
            f = [span_hash(prefix_hash(x), first, last) for x in (h, other)]
            place = places(batch.column(0).to_numpy()[row], pos)
            if not keyed:
                yield pa.record_batch([place, *(pa.array(x.view(np.int64)) for x in f)], ["place", "f1", "f2"])
                continue
            length = np.concatenate([[0], np.cumsum(we - ws)])
            size = length[last] - length[first] + (last - first - 1)
            # the normalised lines: words, with one space after each but the last of a line
            space = np.ones(len(we), bool)
            space[last - 1] = False
            put = word.copy()
            put[we[space]] = True
            plain = np.append(np.where(word, low, 0x20).astype(np.uint8)[put], np.zeros(8, np.uint8))
            begin = np.cumsum(put)[ws[first]] - 1 if len(first) else np.zeros(0, np.int64)
            h, at, some = sampled_grams(plain, begin, size, GRAM, SAMPLE)
            rest = np.ones(len(size), bool)
            rest[some] = False
            rest = np.flatnonzero(rest)
            short = np.flatnonzero(size <= SHORT)
            keys, s = np.empty((KEYS + SHORT_KEYS, len(size)), U64), np.empty((2, len(size)), U64)
            for which, h, at in ((some, h, at), (rest, *grams(plain, begin[rest], size[rest], GRAM))):
                keys[:KEYS, which] = least_keys(h, at, GRAM, ORDERS, KEYS)
                ends = np.append(at[1:], len(h))
                for k, x in enumerate((h, mix(h ^ U64(0x5851F42D4C957F2D))) if len(at) else ()):
                    s[k, which] = simhash(x, at, ends)
            keys[KEYS:, short] = least_keys(*grams(plain, begin[short], size[short], SHORT_GRAM), SHORT_GRAM, SHORT_ORDERS, SHORT_KEYS)
            none = size > SHORT
            form, digits = digitless(plain[:-8], begin, size)
            keys = [pa.array(x.view(np.int64), mask=none if k >= KEYS else None) for k, x in enumerate(keys)]
            keys.append(pa.array(form.view(np.int64), mask=(digits == 0) | (digits > DIGITS * (1 - THRESHOLD) * size)))
            yield pa.record_batch([place, *(pa.array(x.view(np.int64)) for x in (*f, *s)), *keys], ["place", "f1", "f2", "s1", "s2", *names])

    schema = "place decimal(38,0), f1 long, f2 long" + "".join(f", {k} long" for k in ("s1", "s2", *names) if keyed)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[lo:m] == b[lo:m]:
            lo = m
        else:
            hi = m - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[len(a) - m : len(a) - lo] == b[len(b) - m : len(b) - lo]:
            lo = m
        else:
            hi = m - 1
    return a[: len(a) - lo], b[: len(b) - lo]


def aligned_distance(a: str, b: str) -> int:
    """An upper bound of the edit distance: words that stand once in each and in the same order stay, gaps between are replaced."""
    x, y = a.split(" "), b.split(" ")
    cx, cy = Counter(x), Counter(y)
    at = {w: j for j, w in enumerate(y) if cy[w] == 1}
    pairs = [(i, at[w]) for i, w in enumerate(x) if cx[w] == 1 and w in at]
    tails: list[int] = []  # of the longest rising runs of places in y, by length
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tails, j)
        before.append(ends[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[p], ends[p] = j, k
    total, i, j, k = 0, len(x), len(y), ends[-1] if ends else -1
    while True:
        p, q = pairs[k] if k >= 0 else (-1, -1)
        if i - p > 1 or j - q > 1:
            u, v = trimmed(" ".join(["", *x[p + 1 : i], ""]), " ".join(["", *y[q + 1 : j], ""]))
            total += max(len(u), len(v))
        if k < 0:
            return total
        i, j, k = p, q, before[k]


def limited(a: str, b: str, most: int) -> int:
    """The edit distance of two texts, or a number beyond ``most``: a column of the table as the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = mask, 0, len(a), len(b)
    for c in b:
        same = where.get(c, 0)
        still = same | down
        flat = (((same & up) + up) ^ up) | same
        plus, minus = down | (mask & ~(flat | up)), up & flat
        score += bool(plus & top) - bool(minus & top)
        left -= 1
        if score - left > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & mask, minus << 1 & mask
        up, down = minus | (mask & ~(still | plus)), plus & still
    return score


def bounded(a: str, b: str, most: int) -> bool | tuple[str, str]:
    """Whether the edit distance is ``most`` at most, where bounds tell; else what is left to compare."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    if max(len(a), len(b)) > PLAIN and aligned_distance(a, b) <= most:
        return True
    return (a, b) if a and b else False


def within(pairs: list[tuple[str, str]], threshold: float, cells: int = CELLS) -> np.ndarray:
    """Which pairs reach the edit similarity: by bounds, and the rest by edit distance in batches of like lengths."""
    most = np.array([int((1 - threshold) * max(len(a), len(b)) + 1e-9) for a, b in pairs], np.int64)
    found = [bounded(a, b, k) for (a, b), k in zip(pairs, most.tolist(), strict=True)]
    out = np.array([x is True for x in found], bool)
    rest = np.array([i for i, x in enumerate(found) if isinstance(x, tuple)], np.int64)
    size = np.array([max(map(len, found[i])) for i in rest], np.int64)
    order = np.argsort(size, kind="stable")
    rest, size = rest[order], size[order]
    while len(rest):
        longest = int(size[-1])
        n = min(len(rest) - int(np.searchsorted(size, 0.8 * longest)), max(1, cells // (2 * longest)))
        part, rest, size = rest[-n:], rest[:-n], size[:-n]
        if n < FEW + longest // 40:  # too long, or too few, for many at once
            out[part] = [limited(*found[i], k) <= k for i, k in zip(part.tolist(), most[part].tolist(), strict=True)]
        else:
            out[part] = distances([found[i] for i in part.tolist()], int(most[part].max())) <= most[part]
    return out


def distances(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """Edit distances, of all pairs at once, right where they are ``most`` at most and else beyond it.

    A column of each table is bits, 64 rows a word, with carries from word to word. Only words within ``most`` rows of the
    diagonal are computed: above them a distance counts as one more in each column, below them as one more in each row,
    which is never too little. Memory is the pairs times their longest length times their letters, over 8; a batch
    should be of like lengths.
    """
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    count, blocks = len(pairs), int(-(-m.max() // 64))
    both = np.zeros((2, count, max(int(m.max()), int(n.max()))), np.uint32)
    for k in (0, 1):
        for r, p in enumerate(pairs):
            both[k, r, : len(p[k])] = np.frombuffer(p[k].encode("utf-32-le"), np.uint32)
    used = np.zeros(int(both.max()) + 1, bool)
    used[both] = True
    used[0] = False  # past the end
    code = np.cumsum(used)[both]
    letters = int(code.max()) + 1
    if count > 1 and letters * count * blocks * 8 > TABLES:
        half = count // 2
        return np.concatenate([distances(pairs[:half], most), distances(pairs[half:], most)])
    rows = np.arange(count)
    where = np.zeros((blocks, letters, count), U64)  # rows of the first text that hold a letter
    for i in range(int(m.max())):
        where[i // 64, code[0, :, i], rows] |= U64(1 << i % 64)
    where[:, 0] = 0
    where = list(where.reshape(blocks, letters * count))
    at = np.ascontiguousarray(code[1].T) * count + rows
    up, down = np.full((blocks, count), U64(0xFFFFFFFFFFFFFFFF)), np.zeros((blocks, count), U64)
    # the rows of the first texts, as bits
    inside = np.clip(m[None, :] - 64 * np.arange(blocks)[:, None], 0, 64).astype(U64)
    inside = np.where(inside == 0, U64(0), U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - np.maximum(inside, U64(1))))
    out = np.zeros(count, np.int64)
    ones, zero, top = np.ones(count, U64), np.zeros(count, U64), U64(63)
    same, still, flat, plus, minus, *carry = np.empty((9, count), U64)
    for t in range(int(n.max())):
        plus_in, minus_in = ones, zero
        for w in range(max(0, (t - most) // 64), min(blocks - 1, (t + most) // 64) + 1):
            u, d = up[w], down[w]
            where[w].take(at[t], out=same, mode="clip")
            np.bitwise_or(same, d, out=still)
            same |= minus_in
            np.bitwise_and(same, u, out=flat)
            flat += u
            flat ^= u
            flat |= same
            np.bitwise_or(flat, u, out=plus)
            np.invert(plus, out=plus)
            plus |= d
            np.bitwise_and(u, flat, out=minus)
            plus_out, minus_out = carry[2 * (w % 2)], carry[2 * (w % 2) + 1]
            np.right_shift(plus, top, out=plus_out)
            np.right_shift(minus, top, out=minus_out)
            plus += plus  # one row on
            plus |= plus_in
            minus += minus
            minus |= minus_in
            np.bitwise_and(plus, still, out=d)
            plus |= still
            np.invert(plus, out=plus)
            np.bitwise_or(plus, minus, out=u)
            plus_in, minus_in = plus_out, minus_out
        ends = np.flatnonzero(n == t + 1)
        if len(ends):  # a whole column: the top's distance, and what each row adds or takes
            steps = np.bitwise_count(up[:, ends] & inside[:, ends]).astype(np.int64) - np.bitwise_count(down[:, ends] & inside[:, ends])
            out[ends] = t + 1 + steps.sum(axis=0)
    return out


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b, la, lb), the pairs whose lines reach the edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            yield batch.select([0, 1]).filter(pa.array(within(both, threshold)))

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def candidates(x: pa.RecordBatch, y: pa.RecordBatch, threshold: float, radius: int) -> np.ndarray:
    """Pairs of rows of x and y (label, s1, s2, form, line) among which are links that join all labels that any links join.

    Pairs of different labels with near SimHashes or equal digitless forms. Of labels with more than SPARSE such pairs only
    links are given. For these the distance between the first rows of the two labels, less what their other rows differ from these
    at most, settles most pairs of a large class and its neighbours. Where the other pairs are more than MANY a row, they
    are compared here as well. What is compared here goes in batches, nearest first, until its labels are joined.
    """
    label, s1, s2, form, line = ([t.column(t.schema.get_field_index(c)) for t in (x, y)] for c in ("label", "s1", "s2", "form", "line"))
    label = [c.to_numpy() for c in label]
    bits = sum(np.bitwise_count(p.to_numpy().view(U64)[:, None] ^ q.to_numpy().view(U64)[None, :]).astype(np.int16) for p, q in (s1, s2))
    text = [c.to_pylist() for c in line]
    size = [np.array([len(t) for t in c]) for c in text]
    near = bits <= radius + MORE * (np.maximum(size[0][:, None], size[1][None, :]) <= SHORT)
    form, has = [c.fill_null(0).to_numpy() for c in form], [np.asarray(c.is_valid()) for c in form]
    near |= (form[0][:, None] == form[1][None, :]) & has[0][:, None] & has[1][None, :]
    near &= label[0][:, None] != label[1][None, :]
    if x is y:
        near = np.triu(near)
    i, j = np.nonzero(near)
    out = np.zeros(near.shape, bool)
    if not len(i):
        return out
    longer = np.maximum(size[0][i], size[1][j])
    most = np.floor((1 - threshold) * longer + 1e-9).astype(np.int64)
    ok = np.abs(size[0][i] - size[1][j]) <= most
    i, j, most = i[ok], j[ok], most[ok]
    if not len(i):
        return out
    ids, at = np.unique(np.concatenate(label), return_inverse=True)
    at = [at[: len(label[0])], at[len(label[0]) :]]
    group = np.minimum(at[0][i], at[1][j]) * len(ids) + np.maximum(at[0][i], at[1][j])
    group, count = np.unique(group, return_inverse=True, return_counts=True)[1:]
    dense = count[group] > SPARSE
    ok = ~dense
    if dense.any():
        ok[dense] = apart_at_most(label, text, i[dense], j[dense], most[dense])
    if (~dense).sum() <= MANY * sum(near.shape):
        out[i[~dense], j[~dense]] = True
        ok &= dense
    i, j, group = i[ok], j[ok], group[ok]
    order = np.lexsort((bits[i, j], group))
    place = ragged(np.unique(group, return_counts=True)[1])
    order = order[np.lexsort((bits[i[order], j[order]], place))]  # the nearest of each two labels first
    i, j = i[order], j[order]
    parent, step = np.arange(len(ids)), 64
    while len(i):
        step = min(2 * step, BATCH)
        good = within([(text[0][p], text[1][q]) for p, q in zip(i[:step].tolist(), j[:step].tolist(), strict=True)], threshold)
        for p, q in zip(i[:step][good].tolist(), j[:step][good].tolist(), strict=True):
            a, b = at[0][p], at[1][q]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                out[p, q] = True
                parent[max(a, b)] = min(a, b)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        i, j = i[step:], j[step:]
        left = parent[at[0][i]] != parent[at[1][j]]
        i, j = i[left], j[left]
    return out


def apart_at_most(label: list[np.ndarray], text: list[list[str]], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of rows may be ``most`` apart, by the distance of the first rows of their labels and theirs from these."""
    first = [dict(zip(reversed(k.tolist()), range(len(k) - 1, -1, -1), strict=True)) for k in label]
    apart = []
    for side, rows in ((0, i), (1, j)):  # at most so far from the first row of the label
        far = np.zeros(len(text[side]), np.int64)
        for r in np.unique(rows).tolist():
            a, b = trimmed(text[side][r], text[side][first[side][int(label[side][r])]])
            far[r] = min(max(len(a), len(b)), aligned_distance(a, b))
        apart.append(far)
    pivots = [np.array([first[s][int(v)] for v in label[s][rows]]) for s, rows in ((0, i), (1, j))]
    known: dict[tuple[int, int], int] = {}
    for p, q in set(zip(*(v.tolist() for v in pivots), strict=True)):
        if (both := len(text[0][p]) + len(text[1][q])) <= LONG:
            known[p, q] = limited(text[0][p], text[1][q], both)
    between = np.array([known.get(k, 0) for k in zip(*(v.tolist() for v in pivots), strict=True)])
    return between - apart[0][i] - apart[1][j] <= most


#: doc_id and pos of a place
DOC_POS = ("cast((place - pmod(place, 2147483648BD)) div 2147483648BD as long) AS doc_id", "cast(pmod(place, 2147483648BD) as int) AS pos")


def mixed_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Written ``lines`` of the ids in ``rows``, each with its number of letters."""
    return written(lines.join(rows.select("id").distinct(), "id").withColumn("letters", F.length("line")), "mixed-lines")


def similar_classes(docs: DataFrame, one: DataFrame, threshold: float, radius: int) -> DataFrame:
    """(node, component) of the distinct lines ``one`` (id, place, s1, s2, keys) that chains of similar pairs join."""
    keys = [c for c in one.columns if c[0] == "k"]
    shared = stars(one.select("id", F.explode(F.array(*keys)).alias("key")).where("key is not null"))
    # lines that share a key, by their place, and their texts
    cards = one.select("id", "place", "s1", "s2", F.col(keys[-1]).alias("form")).join(shared.select("id").distinct(), "id")
    cards = cards.selectExpr("id", "s1", "s2", "form", *DOC_POS)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).join(cards, ["doc_id", "pos"])
    lines = lines.select("id", "s1", "s2", "form", normalised(F.col("line")).alias("line"))
    lines = written(lines.groupBy("id").agg(*(F.first(c).alias(c) for c in ("s1", "s2", "form")), F.max("line").alias("line")), "compared")

    def verify(pairs: DataFrame, lines: DataFrame = lines) -> DataFrame:
        both = pairs.join(lines.toDF("a", "a1", "a2", "fa", "la"), "a").join(lines.toDF("b", "b1", "b2", "fb", "lb"), "b")
        bits = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
        na, nb = F.length("la"), F.length("lb")
        both = both.where((F.col("fa") == F.col("fb")) | (bits <= F.when(F.greatest(na, nb) <= SHORT, radius + MORE).otherwise(radius))).where(F.least(na, nb) >= threshold * F.greatest(na, nb))
        return similar(both, threshold)

    def settle(rows: DataFrame) -> DataFrame:
        """Compares the lines of mixed buckets; what may be alike goes through the edit distance once.

        Buckets of one part are done in the first round. The lines of larger ones are dealt anew in each round, so that a large
        class is joined in work that grows with its lines; only what then is still several classes is compared in all blocks.
        Most lines are in no mixed bucket: each round moves those of its buckets only.
        """
        held = [mixed_lines(rows, lines)]

        def compare(rows: DataFrame, own: int | None) -> DataFrame:
            cards = rows.join(held[-1], "id").select("cluster", "id", "label", "s1", "s2", "form", "line")
            size = parts(rows.join(held[-1].select("id", "letters"), "id"), letters="letters")
            near = in_blocks(cards, lambda x, y: candidates(x, y, threshold, radius), pairs=True, own=own, size=size)
            return written(verify(near.distinct(), held[-1].drop("letters")), "links")

        links, own = [compare(rows, 0)], [rows]
        size = parts(rows.join(held[0].select("id", "letters"), "id"), letters="letters").where("_g > 1")
        rows = written(rows.join(size.select("cluster"), "cluster"), "large")
        for k in range(1, ROUNDS + 1):
            own.append(rows)
            if rows.isEmpty():
                break
            label = rows.select("id", "label").distinct()
            ends = links[-1].join(label.toDF("a", "u"), "a").join(label.toDF("b", "v"), "b")
            joined = components(ends, "u", "v")
            rows = rows.join(joined.withColumnRenamed("node", "label"), "label", "left").select("cluster", "id", F.coalesce("component", "label").alias("label"))
            mixed = rows.groupBy("cluster").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("cluster")
            rows = written(rows.join(mixed, "cluster"), "large")
            discard(joined)
            if not rows.isEmpty():
                held.append(mixed_lines(rows, held[-1].drop("letters")))
                links.append(compare(rows, k if k < ROUNDS else None))
        discard(*own[1:], *([rows] if rows is not own[-1] else []))
        out = written(reduce(DataFrame.union, links), "links")
        discard(*links, *held)
        return out

    # lines that share a key by chance would chain into one cluster
    found = classes(shared, verify, settle, by_bucket=True)
    discard(shared, lines)
    return found


def duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Written (doc_id, at): the numbers of a text's lines that are not the first of their class, in order of doc_id and place.

    Lines are alike if their normalised forms are equal, or if they share a key, their SimHashes differ in at most
    ``radius`` bits (MORE where both are of SHORT characters at most; lines that share their digitless form may differ in any) and 1 - edit distance / longer length >= ``threshold`` (in characters); classes are chains of
    such pairs. Equal lines are merged before keys move; a very common line is counted where it is read. Texts
    are read once more for the places of lines that go: written, all lines' keys would take half the input.
    """
    docs = docs.where("doc_id is not null")
    at = scan(docs)
    rest = [F.first(c).alias(c) for c in at.columns[3:]]
    one = at.groupBy("f1", "f2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *rest)
    one = written(one.withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = similar_classes(docs, one, threshold, radius)
    named = one.select("f1", "f2", "place", "n", F.col("id").alias("node"))
    alike = written(named.join(found, "node"), "alike")
    first = alike.groupBy("component").agg(F.min("place").alias("keep"))
    alone = named.where("n > 1").join(found.select("node"), "node", "left_anti")
    gone = written(alike.join(first, "component").select("f1", "f2", "keep").union(alone.select("f1", "f2", F.col("place").alias("keep"))), "gone")
    discard(one, found, alike)
    later = scan(docs, keyed=False).join(gone, ["f1", "f2"]).where("place != keep").selectExpr(*DOC_POS)
    out = written(later.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "lines")
    discard(gone)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the text column without duplicate lines, and two columns of counts added (see ``duplicate_lines``).

    Lines end at newlines; a line is removed with its newline. Blank lines (no letter, digit or non-ASCII character)
    are never removed. Null texts stay null with 0 lines; an empty text is one blank line. A text whose lines are
    all removed becomes empty; its row stays. Rows with a null id are left alone. Ids are taken as unique: rows
    repeated with their id lose the same lines. An empty table gives no rows; other columns are kept, but for ones
    with the names in ``counts``, which are replaced (``counts=None`` adds none).
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key, at, parts = fresh(docs, "doc", "at", "parts")
    gone = duplicate_lines(plain, threshold, radius).select(F.col("doc_id").alias(key), F.col("at").alias(at))
    out = docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    out = out.select(*columns(docs), at, pin(F.when(F.col(at).isNotNull(), lines)).alias(parts))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))  # by hash, in order
    text = F.when(F.col(at).isNotNull(), F.array_join(F.transform(left, lambda i: F.col(parts)[i]), "\n")).otherwise(F.col(text_col))
    added = {}
    if counts:
        breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
        added = {counts[0]: F.coalesce(breaks + 1, F.lit(0)).cast("long"), counts[1]: F.coalesce(F.size(at), F.lit(0)).cast("long")}
    keep = [text.alias(text_col) if c == text_col else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in added]
    return out.select(*keep, *(v.alias(k) for k, v in added.items()))


def op3_simhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
