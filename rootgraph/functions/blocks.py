"""Helpers of tasks that compare a block of packed fingerprints with another: bit counts of all pairs, a slab at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: pairs that a task holds at once
SLAB = 1 << 20


def words(column: pa.ChunkedArray, n_words: int) -> np.ndarray:
    """Packed fingerprints as a matrix of unsigned words, a row each."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.empty(0, np.int64)).astype(np.int64, copy=False).view(np.uint64).reshape(-1, n_words)


def bit_counts(w: np.ndarray) -> np.ndarray:
    return np.bitwise_count(w).sum(axis=1, dtype=np.int64)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that each row of ``a`` shares with each row of ``b``."""
    found = np.bitwise_count(a[:, None, 0] & b[None, :, 0])
    for k in range(1, a.shape[1]):
        found = found.astype(np.uint16, copy=False) + np.bitwise_count(a[:, None, k] & b[None, :, k])
    return found


def shares(both: np.ndarray, either: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Tanimoto similarities from counts of common and of all bits."""
    return np.divide(both, either, out=np.full(np.shape(both), empty), where=either > 0)


def slabs(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Parts of an n by m table that hold at most ``SLAB`` pairs."""
    wide = max(1, min(m, SLAB))
    high = max(1, SLAB // wide)
    for i in range(0, n, high):
        for j in range(0, m, wide):
            yield slice(i, i + high), slice(j, j + wide)


def first_of_each(key: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each key in the order of the columns ``order``, sorted by key."""
    at = np.lexsort((*reversed(order), key))
    sorted_key = key[at]
    start = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(at) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - begin < k]


def bounds(own: np.ndarray, cells: np.ndarray, width: int) -> np.ndarray:
    """The highest similarity of a row of the cell ``own`` with one of each of ``cells``: of bit counts p and q of a part, at
    most min(p, q) bits are common and at least max(p, q) are set in either."""
    both = (np.minimum(own, cells) * width + (width - 1)).sum(axis=1)
    low = np.minimum(own, cells) * width + (width - 1)
    either = np.maximum(low, np.maximum(own, cells) * width).sum(axis=1)
    return shares(both, either)


#: bits of a lane, lanes in use at most, rows of a block from which lanes are looked up, and lanes with so many other bits at most
LANE, LANES, FROM, FAR = 16, 4, 1 << 12, 6
#: nanoseconds that looking up a value of a lane, comparing a row found by it, and comparing one of a run of rows take
LOOKED, FOUND, RUN = 8, 14, 8


@lru_cache
def flips(n: int) -> np.ndarray:
    """Every value of a lane with ``n`` bits."""
    every = np.arange(1 << LANE, dtype=np.uint16)
    return every[np.bitwise_count(every) == n]


class Best:
    """The k best of a block for each query so far, ties by the smaller id; rows of the query's own id do not count.

    ``place`` is the place of a row among the block's ids, which rows of equal ids share; ``own`` has those from and up to
    which the rows of a query's own id are.
    """

    def __init__(self, asked: np.ndarray, held: np.ndarray, place: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> None:
        self.asked, self.held, self.place, self.own, self.k = asked, held, place, own, k
        self.n_asked, self.n_held = bit_counts(asked), bit_counts(held)
        n = len(asked)
        self.floor, self.last = np.full(n, -1.0), np.full(n, len(held))
        self.top, self.at = np.full((n, k), -1.0), np.full((n, k), -1)  # similarities and rows, -1 where there is none
        self.far = np.uint8 if held.shape[1] < 4 else np.uint16
        self.reach = np.full(n, np.iinfo(self.far).max, self.far)
        self.steps = np.zeros(n, np.int64)  # of ``looked_up``
        self.lanes: np.ndarray = np.empty(0, np.int64)
        self.compared = [0, 0]

    def own_rows(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.place[rows] >= self.own[0][q]) & (self.place[rows] < self.own[1][q])

    def apart(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The step of ``looked_up`` that meets a row first."""
        other = np.bitwise_count((self.asked[q] ^ self.held[rows]).view(np.uint16)[:, self.lanes]).astype(np.int64)
        return (other * len(self.lanes) + np.arange(len(self.lanes))).min(axis=1)

    def take(self, q: np.ndarray, rows: np.ndarray, h: np.ndarray, step: int | None) -> None:
        """Rows that differ from queries in h bits; those that an earlier step has met are left out."""
        both = (self.n_asked[q] + self.n_held[rows] - h) // 2
        s = shares(both, both + h)
        keep = np.flatnonzero(s >= self.floor[q])
        q, rows, s = q[keep], rows[keep], s[keep]
        keep = ~self.own_rows(q, rows) & ((s > self.floor[q]) | (self.place[rows] < self.last[q]))
        if len(self.lanes):
            first = self.apart(q, rows)
            keep &= (first >= self.steps[q]) if step is None else (first == step)
        if not keep.any():
            return
        met, i = np.unique(q[keep], return_inverse=True)
        old_i, old_j = np.nonzero(self.at[met] >= 0)
        i, s, rows = np.r_[old_i, i], np.r_[self.top[met][old_i, old_j], s[keep]], np.r_[self.at[met][old_i, old_j], rows[keep]]
        chosen = first_of_each(i, -s, self.place[rows], k=self.k)
        i, s, rows = i[chosen], s[chosen], rows[chosen]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        self.top[met[i], nth], self.at[met[i], nth] = s, rows
        full = met[self.at[met, self.k - 1] >= 0]
        self.floor[full], self.last[full] = self.top[full, self.k - 1], self.place[self.at[full, self.k - 1]]
        some = full[self.floor[full] > 0]  # c common bits of c + h: h is c (1 - s) / s, and c no more than the query's bits
        reach = self.n_asked[some] * (1 - self.floor[some]) / self.floor[some]
        self.reach[some] = np.minimum(np.floor(reach + 1e-9), np.iinfo(self.far).max)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which words differ."""
        found = np.bitwise_count(a[..., 0] ^ b[..., 0])
        for w in range(1, a.shape[-1]):
            found = found.astype(self.far, copy=False) + np.bitwise_count(a[..., w] ^ b[..., w])
        return found

    def looked_up(self) -> np.ndarray:
        """Finds the rows nearest in bits by lanes of 16 bits; returns the queries whose k best are not certain by that.

        Of m lanes, step t meets the rows that differ from the query in t div m bits of lane t mod m. After it, every row that
        differs in at most t bits is met. A query needs all within the reach of its k-th best; it leaves when the steps
        to there would take longer than comparing all rows, and a quarter of that time is spent.
        """
        n, every = len(self.held), np.arange(len(self.asked))
        used = np.flatnonzero((np.bitwise_or.reduce(self.held, axis=0) | np.bitwise_or.reduce(self.asked, axis=0)).view(np.uint16)) if n and len(every) else []
        if n < FROM or not 0 < len(used) <= LANES:
            return every
        self.lanes, m = used, len(used)
        order = [np.argsort(self.held.view(np.uint16)[:, c], kind="stable") for c in used]
        held = [self.held[o] for o in order]
        size = [np.bincount(self.held.view(np.uint16)[:, c], minlength=1 << LANE) for c in used]
        begin = [np.cumsum(x) - x for x in size]
        mine = self.asked.view(np.uint16)[:, used]
        price = np.array([len(flips(t // m)) * (LOOKED + FOUND * n / (1 << LANE)) for t in range(FAR * m)])
        price = np.r_[0, np.cumsum(price), np.full(64 * m, np.inf)]
        active, left = every, []
        for t in range(FAR * m):
            need = np.minimum(self.reach[active].astype(np.int64) + 1, len(price) - 1)
            known = self.floor[active] >= 0
            rest = np.where(known, price[np.maximum(need, t)] - price[t], np.inf)
            stop = (price[t + 1] > n * RUN / 4) & (rest > n * RUN)  # the first steps may raise a floor
            left.append(active[stop & ~(known & (need <= t))])
            active = active[~stop & ~(known & (need <= t))]
            if not len(active):
                break
            lane, masks = t % m, flips(t // m)
            wide = max(1, int(SLAB / 4 / (len(masks) * (1 + n / (1 << LANE)))))
            for some in (active[i : i + wide] for i in range(0, len(active), wide)):
                value = (mine[some, lane][:, None] ^ masks[None, :]).astype(np.intp).ravel()
                count = size[lane][value]
                each = count.reshape(len(some), -1).sum(axis=1)
                total = int(each.sum())
                at = np.arange(total) + np.repeat(begin[lane][value] - (np.cumsum(count) - count), count)
                h = self.differ(np.repeat(self.asked[some], each, axis=0), held[lane][at])
                hit = np.flatnonzero(h <= np.repeat(self.reach[some], each))
                early = self.floor[some] < 0
                self.compared[0] += int(each[early].sum())
                self.compared[1] += int(each[~early].sum())
                q = some[np.searchsorted(np.cumsum(each), hit, side="right")]
                self.take(q, order[lane][at[hit]], h[hit].astype(np.int64), t)
            self.steps[active] = t + 1
        return np.sort(np.concatenate([*left, active]))

    def run(self, q: np.ndarray, rows: np.ndarray, wide: int = 1 << 12) -> None:
        """Compares each query with each row; rows are sorted by bit count."""
        wide = min(wide, SLAB)
        high = max(1, SLAB // (8 * wide))
        for a, b in ((q[i : i + high], rows[j : j + wide]) for j in range(0, len(rows), wide) for i in range(0, len(q), high)):
            h = self.differ(self.asked[a][:, None], self.held[b][None, :])
            n = self.n_held[b]
            ends = np.r_[np.flatnonzero(np.diff(n)) + 1, len(n)]
            begins = np.r_[0, ends[:-1]]
            f = self.floor[a][:, None]  # (p + q - h) / 2 common bits of (p + q + h) / 2: the highest h that reaches the floor, for each bit count
            most = np.where(f > 0, (self.n_asked[a][:, None] + n[begins]) * (1 - f) / (1 + np.maximum(f, 0)) + 1e-9, np.inf)
            most = np.minimum(most, np.iinfo(self.far).max).astype(self.far)
            hit = np.empty(h.shape, bool)
            for x, (begin, end) in enumerate(zip(begins, ends, strict=True)):
                np.less_equal(h[:, begin:end], most[:, x : x + 1], out=hit[:, begin:end])
            at = np.flatnonzero(hit)
            if len(at):
                i, j = np.divmod(at, len(b))
                self.take(a[i], b[j], h.ravel()[at].astype(np.int64), None)


def nearest(query_ids: np.ndarray, query_words: np.ndarray, query_cells: np.ndarray, ids: np.ndarray, held: np.ndarray, cells: np.ndarray, width: int, k: int, first: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[int]]:
    """The k best of the block (place of the query, place in the block, similarity) for each query, ties by the smaller id; and
    the pairs compared before a query had its k and after.

    Short fingerprints are looked up by lanes first. For what is then not certain, queries of one cell go together. They
    visit the block's cells in order of the bounds, some more rows in each step, until no bound reaches the k-th best of any
    query. Rows of the query's own id do not count. Equal queries are one, where ids are unique.
    """
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.searchsorted(ranked, ranked)  # equal ids share the first place
    own = np.searchsorted(ranked, query_ids, "left"), np.searchsorted(ranked, query_ids, "right")
    _, one, same = np.unique(query_words, axis=0, return_index=True, return_inverse=True) if len(query_words) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    same = same.ravel()
    if len(one) < 0.9 * len(same) and (own[1] - own[0]).max() <= 1:  # a query's own row is one of the k + 1 best at most
        best = Best(query_words[one], held, rank, (np.zeros(len(one), np.int64),) * 2, k + 1)
        _visited(best, query_cells[one], cells, width, first)
        at, top = best.at[same], best.top[same]
        mine = (rank[at] >= own[0][:, None]) & (rank[at] < own[1][:, None]) & (at >= 0)
        kept = np.argsort(mine, axis=1, kind="stable")[:, :k]
        mine, at, top = (np.take_along_axis(x, kept, axis=1) for x in (mine, at, top))
        at[mine] = -1
    else:
        best = Best(query_words, held, rank, own, k)
        _visited(best, query_cells, cells, width, first)
        at, top = best.at, best.top
    i, j = np.nonzero(at >= 0)
    return [(i, at[i, j], top[i, j])], best.compared


def _visited(best: Best, asked_cells: np.ndarray, cells: np.ndarray, width: int, first: int) -> None:
    """``best`` of all rows of a block, which lie in cells."""
    places, at = np.unique(cells, axis=0, return_inverse=True)
    at = at.ravel()
    by_count = np.argsort(best.n_held, kind="stable")
    cell = at[by_count]
    by_cell = by_count[np.argsort(cell, kind="stable")]
    sizes = np.bincount(at, minlength=len(places))
    begins = np.r_[0, np.cumsum(sizes)]
    left = best.looked_up()
    if not len(left):
        return
    kinds, mine = np.unique(asked_cells[left], axis=0, return_inverse=True)
    left = left[np.argsort(mine.ravel(), kind="stable")]
    for rows, kind in zip(np.split(left, np.cumsum(np.bincount(mine.ravel(), minlength=len(kinds)))[:-1]), kinds, strict=True):
        bound = bounds(kind, places, width)
        visit = np.argsort(-bound, kind="stable")
        bound = bound[visit]
        step, size = 0, first
        while step < len(visit):
            lowest = best.floor[rows].min()
            if bound[step] < lowest:
                break
            size = min(size, 1 << 12) if lowest < 0 else max(size, 1 << 14)
            stop, n = step, 0
            while stop < len(visit) and n < size and bound[stop] >= lowest:
                n += sizes[visit[stop]]
                stop += 1
            if n < len(cell) // 32:
                some = np.concatenate([by_cell[begins[c] : begins[c + 1]] for c in visit[step:stop]])
                some = some[np.argsort(best.n_held[some], kind="stable")]
            else:
                now = np.zeros(len(places), bool)
                now[visit[step:stop]] = True
                some = by_count[now[cell]]
            active = rows[best.floor[rows] <= bound[step]]
            itself = active[best.own[0][active] < best.own[1][active]]
            best.compared[0 if lowest < 0 else 1] += len(active) * len(some) - sum(int(best.own_rows(q, some).sum()) for q in itself) if len(best.held) < FROM else len(active) * len(some)
            best.run(active, some)
            step, size = stop, 2 * size


def fractions(n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every similarity that fingerprints of ``n_bits`` can have, and the number of it for (common bits, all bits)."""
    both, either = np.meshgrid(np.arange(n_bits + 1), np.arange(n_bits + 1), indexing="ij")
    values = np.where(both <= either, shares(both, either), 0.0)
    every, number = np.unique(values, return_inverse=True)
    return every, number.reshape(values.shape).astype(np.int32)


def numbered(a: np.ndarray, b: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers of the similarities of all pairs of two blocks, by the table of ``fractions``."""
    both = common(a, b)
    either = (bit_counts(a)[:, None] + bit_counts(b)[None, :]).astype(np.int32) - both
    return np.take(number, both.astype(np.int32) * number.shape[1] + either)


def rectangles(a: np.ndarray | None, b: np.ndarray | None, n: int, m: int, same: bool) -> Iterator[tuple[object, object, np.ndarray, np.ndarray, bool]]:
    """(low, high, rows of one block, rows of the other, whether these are the same rows) that hold each unordered pair once.

    With labels only rows of different labels pair up. ``same``: the two blocks are one, in the same order.
    """
    if a is None:
        yield None, None, np.arange(n), np.arange(m), same
        return
    left, right = ({v: np.flatnonzero(x == v) for v in np.unique(x)} for x in (a, b))
    for u, i in left.items():
        for v, j in right.items():
            if u < v or (v < u and not same):
                yield min(u, v), max(u, v), i, j, False


def alike(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begins, kinds): rows in order of cells with equal bit counts of both words and equal ``times``; where each cell
    begins, with the end; and these three numbers of each cell."""
    every = np.stack([bit_counts(x), bit_counts(y), times], axis=1)
    kinds, at = np.unique(every, axis=0, return_inverse=True)
    at = at.ravel()
    return np.argsort(at, kind="stable"), np.r_[0, np.cumsum(np.bincount(at, minlength=len(kinds)))], kinds


#: pairs of two sets of rows from which they are counted by cells
MANY = 1 << 27


def tally(a: dict[str, np.ndarray], b: dict[str, np.ndarray], bits: dict[str, int], couples: list[tuple[str, str]], differ: str | None, same: bool, times: tuple[np.ndarray, np.ndarray] | None = None) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each couple of columns the similarities that pairs of two sets of rows have in both, and how many have them.

    ``times`` says how many rows each stands for. ``differ``, one of each couple, leaves out pairs with the same word in it.
    """
    if differ and any(differ not in c for c in couples):
        raise ValueError("differ must be one of each couple")
    tables = {c: fractions(n) for c, n in bits.items()}
    n, m = (len(next(iter(t.values()))) for t in (a, b))
    times = times or (np.ones(n, np.int64), np.ones(m, np.int64))
    found = _by_cells if n * m >= MANY else _by_pairs
    out = {}
    for (x, y), held in found(a, b, tables, couples, differ, same, times).items():
        (values_x, number_x), (values_y, number_y) = tables[x], tables[y]
        if same and not differ:  # the rows that one stands for, among each other
            px, py = bit_counts(a[x]), bit_counts(a[y])
            np.add.at(held, number_x[px, px].astype(np.int64) * len(values_y) + number_y[py, py], times[0] * (times[0] - 1) // 2)
        at = np.flatnonzero(held)
        i, j = np.divmod(at, len(values_y))
        out[x, y] = (values_x[i], values_y[j], held[at])
    return out


def _by_pairs(a: dict, b: dict, tables: dict, couples: list, differ: str | None, same: bool, times: tuple[np.ndarray, np.ndarray]) -> dict[tuple[str, str], np.ndarray]:
    shape = {c: (len(tables[c[0]][0]), len(tables[c[1]][0])) for c in couples}
    held = {c: np.zeros(s[0] * s[1], np.int64) for c, s in shape.items()}
    n, m = (len(t) for t in times)
    weighed = max(t.max(initial=1) for t in times) > 1
    for r, c in slabs(n, m):
        keep = np.ones((len(times[0][r]), 1), bool)
        if same:
            at = np.arange(n)
            keep = at[r][:, None] < at[c][None, :]
        if differ:
            keep = keep & (a[differ][r] != b[differ][c].T)
        whole = keep.all()
        number = {x: numbered(a[x][r], b[x][c], tables[x][1]) for x in tables}
        keep = np.broadcast_to(keep, (len(times[0][r]), len(times[1][c])))
        weights = (times[0][r][:, None] * times[1][c][None, :])[keep] if weighed else None
        for x, y in couples:
            both = number[x] * np.int32(shape[x, y][1]) + number[y]
            held[x, y] += np.bincount(both.ravel() if whole else both[keep], weights, len(held[x, y])).astype(np.int64)
    return held


def _by_cells(a: dict, b: dict, tables: dict, couples: list, differ: str | None, same: bool, times: tuple[np.ndarray, np.ndarray]) -> dict[tuple[str, str], np.ndarray]:
    """Rows of equal bit counts go together: there common bits say all, so these are counted, and the counts are turned into similarities."""
    out = {}
    for x, y in couples:
        (values_x, number_x), (values_y, number_y) = tables[x], tables[y]
        held = np.zeros(len(values_x) * len(values_y), np.int64)
        sides = []
        for t, n in zip((a, b), times, strict=True):
            order, begins, kinds = alike(t[x], t[y], n)
            sides.append((t[x][order, 0], t[y][order, 0], begins, kinds))
        (u, v, begins, kinds), (q, r, ends, others) = sides
        for cell, (px, py, w) in enumerate(kinds):
            rows = slice(begins[cell], begins[cell + 1])
            first = cell if same else 0  # cells of both sides are the same then, and each two meet once
            per = (px + 1) * (py + 1)
            counted = np.zeros((len(others) - first) * per, np.int64)
            at = np.repeat(np.arange(len(others) - first), np.diff(ends)[first:]) * per
            n = rows.stop - rows.start
            wide = max(1, min(SLAB, max(1 << 12, SLAB // 8 // n)))
            high = max(1, SLAB // 8 // wide)
            for j in range(0, len(at), wide):
                c, base = slice(ends[first] + j, ends[first] + j + wide), at[j : j + wide]
                low, base = base[0], base - base[0]
                for i in range(rows.start, rows.stop, high):
                    k = slice(i, min(i + high, rows.stop))
                    code = np.bitwise_count(u[k, None] & q[None, c]).astype(np.uint16)
                    code *= np.uint16(py + 1)
                    code += np.bitwise_count(v[k, None] & r[None, c])
                    got = np.bincount((code + base).ravel())
                    counted[low : low + len(got)] += got
            if same:  # its own cell: both orders of each two rows, and each row with itself
                own = counted[:per]
                own[per - 1] -= n
                own //= 2
            some = np.flatnonzero(counted)
            met, code = np.divmod(some, per)
            cx, cy = np.divmod(code, py + 1)
            qx, qy, m = others[first + met].T
            many = counted[some] * m * w
            if differ:
                many[(cx == px) & (qx == px) if differ == x else (cy == py) & (qy == py)] = 0
            np.add.at(held, number_x[cx, px + qx - cx].astype(np.int64) * len(values_y) + number_y[cy, py + qy - cy], many)
        out[x, y] = held
    return out


def extremes(a: dict[str, np.ndarray], b: dict[str, np.ndarray], ids: tuple[np.ndarray, np.ndarray], bits: dict[str, int], couple: tuple[str, str], differ: str, k: int, sign: int) -> tuple[np.ndarray, ...]:
    """(i, j, first, second) of the ``k`` pairs of two sets of rows with the largest ``sign`` * (first - second), to nine places,
    ties by the smaller id i, then by j > i."""
    x, y = couple
    (u, number_x), (v, number_y) = (fractions(bits[c]) for c in couple)
    gains, order = np.unique(np.round(sign * (u[:, None] - v[None, :]), 9), return_inverse=True)
    order = order.reshape(len(u), len(v)).astype(np.int32)
    best = tuple(np.empty(0, t) for t in (np.int64, ids[0].dtype, ids[0].dtype, np.float64, np.float64))
    for r, c in slabs(len(a[x]), len(b[x])):
        nx, ny = numbered(a[x][r], b[x][c], number_x), numbered(a[y][r], b[y][c], number_y)
        gain = np.take(order.ravel(), nx * np.int32(len(v)) + ny)
        floor = best[0][-1] if len(best[0]) == k else -1
        i, j = np.divmod(np.flatnonzero((gain >= floor) & (a[differ][r] != b[differ][c].T)), gain.shape[1])
        p, q = ids[0][r][i], ids[1][c][j]
        new = (gain[i, j].astype(np.int64), np.minimum(p, q), np.maximum(p, q), u[nx[i, j]], v[ny[i, j]])
        best = tuple(np.concatenate(z) for z in zip(best, new, strict=True))
        at = np.lexsort((best[2], best[1], -best[0]))[:k]
        best = tuple(z[at] for z in best)
    return best[1:]
