"""Operator 8: minimax contiguous partition of documents into shards of nearly equal bytes."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import ranked, table, written

#: bits of the order key that one refinement adds; at most 2^STEP cells come back for each refined cell
STEP = 12


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut indexes when each shard takes as many atoms as fit, or None if that needs more shards."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    cuts, at, base = [], 0, 0
    while at < len(sizes):
        nxt = bisect.bisect_right(ends, base + capacity, at)
        if nxt == at or len(cuts) == shards:
            return None
        at, base = nxt, ends[nxt - 1]
        cuts.append(at)
    return cuts


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which the greedy check succeeds, by binary search, and its cut indexes."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(sizes, low, shards) or []


def _reach(atoms: list[dict], capacity: int, shards: int, divide: bool) -> list[int]:
    """Atom index that each greedy cut falls in; with ``divide`` unresolved atoms may be split anywhere."""
    out, at, left = [], 0, atoms[0]["size"] if atoms else 0
    for _ in range(shards):
        room = capacity
        while at < len(atoms) and (left <= room or divide and not atoms[at]["one"]):
            if left > room:
                left -= room
                break
            room -= left
            at += 1
            left = atoms[at]["size"] if at < len(atoms) else 0
        else:
            left = atoms[at]["size"] if at < len(atoms) else 0
        out.append(at)
    return out


def cut_keys(rows: DataFrame, shards: int) -> list[int]:
    """Order keys at which shards 1.. begin.

    ``rows`` holds k (order key, equal within a group) and size. Cells of key prefixes are summed and
    refined only where a cut may fall, so what reaches the driver is bounded whatever the row count.
    """

    def cells(part: DataFrame, bits: int) -> list[dict]:
        got = part.groupBy(F.shiftright("k", 64 - bits).alias("cell") if bits < 64 else F.col("k").alias("cell"))
        got = got.agg(F.sum("size").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
        return [{"lo": r.lo, "hi": r.hi, "size": r.size, "one": r.lo == r.hi, "bits": bits, "cell": r.cell} for r in got]

    atoms = sorted(cells(rows, STEP), key=lambda a: a["lo"])
    total = sum(a["size"] for a in atoms)
    while True:
        active = [i for i, a in enumerate(atoms) if not a["one"] and a["size"] * 64 * shards > total]
        if not active:
            high = minimax([a["size"] for a in atoms], shards)[0]
            low = max([-(-total // shards), *(a["size"] for a in atoms if a["one"])])
            early, late = _reach(atoms, low, shards, False), _reach(atoms, high, shards, True)
            active = sorted({i for x, y in zip(early, late, strict=True) for i in range(max(0, x - 1), min(len(atoms), y + 1)) if not atoms[i]["one"]})
        if not active:
            break
        ranges = [atoms[i] for i in active[:64]]
        bits = min(64, min(a["bits"] for a in ranges) + STEP)
        ranges = [a for a in ranges if a["bits"] < bits]
        inside = F.lit(False)
        for a in ranges:
            inside = inside | F.col("k").between(F.lit(a["lo"]), F.lit(a["hi"]))
        gone = {a["lo"] for a in ranges}
        atoms = sorted([a for a in atoms if a["lo"] not in gone] + cells(rows.where(inside), bits), key=lambda a: a["lo"])
    cuts = minimax([a["size"] for a in atoms], shards)[1]
    return [atoms[c]["lo"] for c in cuts if c < len(atoms)]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of ``shards`` shards of nearly equal bytes; rows of equal text stay together.

    Groups are ordered by a 64-bit hash of the text; the smallest feasible shard capacity is found by binary
    search with a greedy check, and shards are cut there. Returns id, size, text_crc32, law, shard, slot, grown_shard.
    A null text has size 1 and CRC 0, and all null texts form one group; an empty text likewise has size 1.
    An empty table gives no rows; repeated rows each get a slot; other columns are ignored. The one group
    larger than an equal share (a text that makes up more than 1/shards of the bytes) fills a shard alone.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k"),
    )
    rows = written(rows, "sizes")
    shard = F.lit(0)
    for key in cut_keys(rows.select("k", "size"), shards):
        shard = shard + (F.col("k") >= F.lit(key)).cast("int")
    out = ranked(rows.withColumn("shard", shard), ["shard"], ["k", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8)
