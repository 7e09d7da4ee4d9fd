"""Operator 4: packing token sequences with Martello-Toth dominance reduction, then best fit."""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import ranked, table, written
from rootgraph.llm.kernels import pieces, ragged

CAPACITY = 2048
#: words whose ids a worker remembers before it starts anew
REMEMBERED = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of strings, each encoded once and then looked up.

    The tokenizer lower-cases, drops white space, and never joins across it nor between letters and punctuation,
    so a text's ids are those of such parts in turn.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, for strings of letters only: one call for all, as each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(strings), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(strings) or len(ids) != ends[-1]:
            return self._each(strings)
        return ids, np.diff(ends, prepend=0)

    def encode(self, strings: list[str]) -> np.ndarray:
        """Places in ``off`` of the strings."""
        if len(self.place) > REMEMBERED:
            self.clear()
        if new := [s for s in strings if s not in self.place]:
            plain = [s for s in new if s.isalpha()]
            other = [s for s in new if not s.isalpha()]
            got = [self._joined(plain[i : i + 512]) for i in range(0, len(plain), 512)] + ([self._each(other)] if other else [])
            self.place.update(zip([*plain, *other], range(len(self.off) - 1, len(self.off) - 1 + len(new)), strict=True))
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.concatenate([n for _, n in got]))])
            self.ids = np.concatenate([self.ids, *(x for x, _ in got)])
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))


_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_LOWER = np.arange(256, dtype=np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII punctuation but the apostrophe, which may begin a contraction
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False
_LOWER[65:91] += 32


def token_ids(encoder: Words, data: np.ndarray, start: np.ndarray, end: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in turn, each followed by ``stop``, and how many each row has."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    low = _LOWER[data]
    raw = low.tobytes()
    if any(t in raw for t in encoder.special):  # such strings are found before lower case and parts
        low = data
    else:
        letter, mark = _LETTER[data], _MARK[data]
        edge[1:-1] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    edge[start] = edge[end] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    off = np.zeros(len(ws) + 1, np.int32)
    np.cumsum(we - ws, out=off[1:])
    strings = pa.StringArray.from_buffers(len(ws), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(low[solid]))).dictionary_encode()
    place = encoder.encode(strings.dictionary.to_pylist())
    place = place[np.asarray(strings.indices)] if len(ws) else np.zeros(0, np.int64)
    n = encoder.off[place + 1] - encoder.off[place]
    ends = np.concatenate([[0], np.cumsum(n)])
    count = ends[np.searchsorted(ws, end)] - ends[np.searchsorted(ws, start)] + 1
    out = np.full(int(count.sum()), stop, np.uint32)
    body = np.ones(len(out), bool)
    body[np.cumsum(count) - 1] = False
    out[body] = encoder.ids[np.repeat(encoder.off[place] - ends[:-1], n) + np.arange(int(ends[-1]))]
    return out, count


_encoders: dict[str, Words] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the closing id 0, cut into pieces of at most ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Words(tokenizer))
        for batch, data, start, end in pieces(batches):
            ids, count = token_ids(encoder, data, start, end)
            number = -(-count // capacity)
            row, piece = np.repeat(np.arange(len(count)), number), ragged(number)
            length = np.minimum(capacity, count[row] - piece * capacity)
            at = np.repeat(np.cumsum(count) - count, number) + piece * capacity
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fixes bins that some optimal packing holds, taking their items out of ``counts`` (size to number).

    For an item j in order of size: alone if nothing fits beside it; with the item that fills the bin exactly;
    with the largest fitting item if no two fit beside it, or if none of the pairs that do is larger; with the
    best pair if its larger item is that largest one and no three fit and the pair leaves no rival.
    Equal items are handled together. Returns (sizes of a bin, number of such bins).
    """
    bins: list[tuple[list[int], int]] = []

    def take(*sizes: int) -> None:
        n = min(counts[s] // sizes.count(s) for s in sizes)  # the reason holds as well once some are gone
        bins.append((list(sizes), n))
        for s in sizes:
            counts[s] = counts[s] - n
            if not counts[s]:
                del counts[s]

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = capacity - j
            counts[j] -= 1  # one j is placed; the rest may stand beside it
            have = sorted(s for s, n in counts.items() if n)
            smallest = [s for s in have[:3] for _ in range(min(3, counts[s]))][:3]
            fits = bisect.bisect_right(have, room)
            best = have[fits - 1] if fits else 0
            counts[j] += 1
            pair_fits = len(smallest) > 1 and sum(smallest[:2]) <= room
            triple_fits = len(smallest) > 2 and sum(smallest) <= room
            if not fits:
                take(j)
            elif best == room or not pair_fits:
                take(j, best)
            elif not triple_fits:
                counts[j] -= 1
                pair, lo, hi = (0, 0), 0, fits - 1
                while lo <= hi:
                    if have[lo] + have[hi] > room or lo == hi and counts[have[lo]] < 2:
                        hi -= 1
                        continue
                    pair = max(pair, (have[lo] + have[hi], have[hi]))
                    lo += 1
                counts[j] += 1
                total, a = pair
                if best >= total:
                    take(j, best)
                elif a == best and _no_rival(counts, j, a, total - a, room):
                    take(j, a, total - a)
                else:
                    break
            else:
                break
    return bins


def _no_rival(counts: dict[int, int], j: int, a: int, b: int, room: int) -> bool:
    """Whether (a, b) matches every pair beside j item by item: two items between them in size cannot both fit."""
    between = sorted(s for s in counts if b < s <= a for _ in range(min(2, counts[s] - (s == a) - (s == j))))
    return len(between) < 2 or between[0] + between[1] > room


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over (size to number): each item goes to the fullest bin that takes it."""
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, chain: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, chain))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                each = capacity // s
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * s, full, (s, each, None))
                if rest:
                    put(capacity - rest * s, 1, (s, rest, None))
                break
            room = rooms[k]
            n, chain = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            each = room // s
            full = min(n, left // each)
            left -= full * each
            if full:
                put(room - each * s, full, (s, each, chain))
            if full < n and left:
                put(room - left * s, 1, (s, left, chain))
                full, left = full + 1, 0
            if full < n:
                put(room, n - full, chain)
    out = []
    for groups in by_room.values():
        for n, chain in groups:
            sizes: list[int] = []
            while chain:
                sizes = [chain[0]] * chain[1] + sizes
                chain = chain[2]
            out.append((sizes, n))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (size, first rank, past-the-last rank, first sequence, offset), sorted; ranks count equal sizes.

    Its size depends on how many different sizes there are (``capacity`` at most), not on how many items.
    """
    left = dict(counts)
    bins = reduce_dominated(left, capacity)
    bins += best_fit(left, capacity)
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for sizes, n in bins:
        at = 0
        for s in sizes:
            runs.append((s, used.get(s, 0), used.get(s, 0) + n, sequence, at))
            used[s] = used.get(s, 0) + n
            at += s
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token ids of all rows into as few sequences of at most ``capacity`` as the method finds.

    Only longer documents are cut. As lengths are integers up to ``capacity``, the instance is a histogram of
    bounded size, solved on the driver (dominance reduction, then best fit) into runs of ranks; rows find their
    place by their rank among rows of equal length. Returns a row for each piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Null and empty texts are the closing id alone; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(token_pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    cut = ranked(cut, ["length"], ["doc_id", "piece"], "rank")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    base = int(runs[:, 2].max()) + 1 if len(runs) else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] * base + runs[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(key, length * base + rank, "right") - 1
            yield pa.record_batch([*(b.column(b.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
