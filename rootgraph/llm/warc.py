"""Operator 1: a deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm.common import new_path, table, written

#: payload bytes of a shard, compressed bytes at which a file is closed, least payload that a revisit may stand for
SHARD_BYTES, ROLL_BYTES, LEAST_REVISIT = 32 << 20, 4 << 20, 100
#: keys sampled for each shard when its bounds are set
OVERSAMPLE = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page} {digest}'.encode()).hexdigest()[:32])}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with regenerated headers and digests, as a gzip member of its own."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_header(url)}"] if url is not None else []
    head += [f"WARC-Page-ID: {page}"] if page is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}"] if revisit else []
    head += [f"WARC-Refers-To-Page-ID: {refers}"] if revisit and refers is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)  # a gzip header without a time
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """One record's fields; checks its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(block) != int(field["Content-Length"]) or f"sha256:{hashlib.sha256(block).hexdigest()}" != field["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {field.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {field['WARC-Record-ID']}")
    number = lambda k: int(field[k]) if k in field else None
    return {"page_id": number("WARC-Page-ID"), "url": field.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if field["WARC-Type"] == "response" else None}


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    data = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = data or stream.read(block)
            if not data:
                if parts:
                    raise ValueError("the file ends within a record")
                return
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield b"".join(parts)


class Roller:
    """Writes files of one shard, each closed at ``roll`` compressed bytes, through temporary names."""

    def __init__(self, root: str, shard: int, roll: int):
        self.files, self.root = _files(root)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None
        self.done: list[tuple] = []

    def write(self, data: bytes) -> None:
        if self.out and self.size + len(data) > self.roll:
            self.done.append(self.close())
        if not self.out:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.size, self.count, self.sum = self.files.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self.number += 1
        self.out.write(data)
        self.size += len(data)
        self.count += 1
        self.sum.update(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.files.move(self.temporary, f"{self.root}/{self.name}")  # the same bytes whichever attempt comes last
        return self.name, self.shard, self.size, self.count, self.sum.hexdigest()


def shard_bounds(keys: DataFrame, shards: int) -> list[tuple]:
    """Range bounds of (page_id, digest): quantiles of keys chosen by their hash, so the same whatever the partitions."""
    if shards < 2:
        return []
    n = keys.count()
    rate = min(1.0, shards * OVERSAMPLE / max(1, n))
    some = keys.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 30)) < rate * (1 << 30))
    got = sorted((r.page_id is None, r.page_id or 0, r.digest) for r in some.select("page_id", "digest").distinct().collect())
    return sorted({got[len(got) * k // shards] for k in range(1, shards)}) if got else []


def write_warc(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll: int = ROLL_BYTES, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row under ``root`` and returns the manifest (file, shard, bytes, records, sha256).

    Rows are range-partitioned by (id, digest, url) at bounds that depend on the rows alone and sorted, so the
    archives are the same bytes on every run. Files appear by rename from temporary names; the manifest, a table
    in ``root``/_manifest committed after the last file, says which files count. Of equal payloads of at least
    ``least`` bytes the smallest id keeps the payload and the rest refer to it. Pages move once, and what makes a
    row a revisit travels as small rows merged in order with them.
    Null html is an empty payload; null ids come last and refer to nothing if no id is known; of repeated rows with
    the smallest id one is the response; a null url is left out; an empty table gives an empty manifest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest")
    keys = written(rows.select("page_id", digest, F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("n")), "payloads")
    shards = max(1, -(-(keys.agg(F.sum("n")).first()[0] or 0) // shard_bytes))
    bounds = shard_bounds(keys, shards)

    @F.pandas_udf("int")
    def shard_of(none, page, digest):
        import pandas as pd

        return pd.Series([bisect.bisect_right(bounds, (x, p, d)) for x, p, d in zip(none.tolist(), page.tolist(), digest, strict=True)], dtype="int32")

    dup = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("copies")).where("copies > 1")
    notes = keys.join(dup, "digest").select("page_id", "digest", "refers").distinct()
    both = rows.select("page_id", digest, F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers"))
    both = notes.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers").union(both)
    both = both.withColumn("shard", shard_of(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), "digest")) if bounds else both.withColumn("shard", F.lit(0))
    both = both.repartitionById(len(bounds) + 1, F.col("shard")) if bounds else both.coalesce(1)
    both = both.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", F.col("url").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note, first = None, None, None

        def finish() -> list[tuple]:
            return roller.done + ([roller.close()] if roller.out else []) if roller else []

        def manifest(done: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "bytes", "records", "sha256"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page, dig, kind, url, html, refers, shard = (x.as_py() for x in row)
                if not kind:
                    note, first = (page, dig, refers), True
                    continue
                if roller is None or roller.shard != shard:
                    yield manifest(finish())
                    roller = Roller(root, shard, roll)
                twin = note is not None and note[:2] == (page, dig)
                revisit = twin and not (first and page == note[2])
                roller.write(record(page, url, (html or "").encode(), dig, note[2] if twin else None, revisit))
                first = False if twin else first
        yield manifest(finish())

    path = f"{root}/_manifest"
    both.mapInArrow(write, "file string, shard int, bytes long, records long, sha256 string").write.parquet(path)
    spark = pages.sparkSession
    files, base = _files(root)
    if files.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        files.delete_dir(f"{base}/_temporary")  # left by lost attempts
    return spark.read.schema("file string, shard int, bytes long, records long, sha256 string").parquet(path)


def read_warc(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest names, with digests checked; payloads on request."""
    manifest = spark.read.schema("file string, shard int, bytes long, records long, sha256 string").parquet(f"{root}/_manifest")
    n = max(1, manifest.count())
    kinds = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("file", pa.string(), "string")]
    kinds += [("payload", pa.binary(), "binary")] if payloads else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(root)
        make = lambda rows: pa.record_batch([pa.array([r[k] for r in rows], t) for k, t, _ in kinds], [k for k, _, _ in kinds])
        for batch in batches:
            for name, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, count, held = [], 0, 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        r = parse(data) | {"file": name}
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        count, held = count + 1, held + (len(data) if payloads else 0)
                        if len(rows) == 5000 or held > 16 << 20:
                            yield make(rows)
                            rows, held = [], 0
                if count != want:
                    raise ValueError(f"{name} holds {count} records, the manifest says {want}")
                yield make(rows)

    return manifest.select("file", "records").repartition(n, "file").mapInArrow(read, ", ".join(f"{k} {s}" for k, _, s in kinds))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, octet_length(encode(h)) >= 100 AND page_id <> first AS again
      FROM (SELECT *, min(page_id) OVER (PARTITION BY d) AS first
            FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages)))
"""
