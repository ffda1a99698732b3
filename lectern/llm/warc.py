"""WARC: a deterministic sharded writer and its reader.

Records are range-sorted: the ids are cut into shards of about SHARD_BYTES of payload, by counted cells that
are cut again where they are heavy (ids by digest, where one id is), so outliers and frequent or null ids don't fill a
shard; a sort by (shard, id, digest) within the shards orders the records. A task writes a shard's records as gzip
members under a temporary name, rolls to a new file when the compressed size
passes ROLL_BYTES, and renames each finished file to a name made of shard and
sequence alone; headers (record id, digests, lengths, dates) are regenerated from
the records, so the same table gives the same bytes on any cluster, and a task
that is run again replaces its files by equal ones. A file begins with a warcinfo record. The job is committed by the
manifest, a Parquet table with a row for each file (records, bytes, SHA-256),
which Spark's committer puts in place once all tasks are done; then temporary files that failed attempts left are removed. The reader opens
only what the manifest names, and checks it. It reads other writers' records, too: kinds but response
and revisit are passed over, and what the file doesn't say is null.

Of records with equal payloads of at least REVISIT_BYTES, the one with the
largest id is a response and the others revisit it. A holder's id reaches the
other records by sorting: small instruction rows (id, digest, holder) travel in
the same exchange and stand right before the records they are for.

Cases: null html is an empty payload; null ids sort last and are never holders
unless all ids of a payload are null; rows of equal id and payload are all
responses if they hold the largest id, and their record ids end in a number from the second on; smaller payloads are all responses; very
long payloads are one record; an empty table gives an empty manifest; other
columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import ranges, scratch, small_batches

REVISIT_BYTES, SHARD_BYTES, ROLL_BYTES = 1000, 32 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"


def store_of(path: str):
    """pyarrow's file system for a URI and the path on it, so that executors write where Spark's shared folder is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def block_of(head: list[tuple[str, str]], block: bytes) -> bytes:
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(file: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return block_of([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{file}>"), ("WARC-Date", DATE), ("WARC-Filename", file), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))], block)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, holder: int | None, nth: int = 0) -> bytes:
    name = lambda i, n=0: f"<urn:page:{'null' if i is None else i}:{digest}{f':{n}' if n else ''}>"
    kind = "response" if holder is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if holder is None else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(page_id, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", name(holder)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if holder is not None else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return block_of(head, block)


class ShardWriter:
    def __init__(self, root: str, attempt: str, roll: int):
        self.fs, self.root = store_of(root)
        self.attempt, self.roll = attempt, roll
        self.shard, self.seq, self.out, self.done = None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"part-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/.tmp-{self.name}-{self.attempt}"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self.write(info(self.name))
        self.write(data)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def write(self, data: bytes) -> None:
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write_archive(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes page_id, url, html as WARC files under root; returns the committed manifest."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    size = F.octet_length("html")
    tie = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")
    slim = rows.where(size >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    holders = slim.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("ids")).where("ids > 1 and holder is not null").drop("ids")
    told = slim.join(holders, "digest").where(~F.col("page_id").eqNullSafe(F.col("holder")))
    told = told.select("page_id", F.lit("").alias("url"), F.lit("").alias("html"), "digest", "holder")
    every = rows.withColumn("holder", F.lit(None).cast("bigint")).withColumn("kind", F.lit(1)).unionByName(told.withColumn("kind", F.lit(0)))
    every, shards = ranges(every.withColumn("tie", tie), ["page_id", "tie"], size + 200, shard_bytes, out="shard")
    every = every.select("shard", "page_id", "digest", "kind", "url", "html", "holder")
    every = every.repartition(max(1, min(shards, 4096)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = ShardWriter(root, str(TaskContext.get().taskAttemptId()), roll_bytes)
        last, holder, nth = None, None, 0
        for batch in batches:
            for s, page_id, digest, kind, url, html, told_holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (page_id, digest):
                    last, holder, nth = (page_id, digest), None, 0
                if kind == 0:
                    holder = told_holder
                else:
                    writer.add(s, record(page_id, url, html.encode(), digest, holder, nth))
                    nth += 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in writer.done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "shard", "records", "bytes", "sha256"])

    manifest = every.mapInArrow(run, "file string, shard bigint, records bigint, bytes bigint, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{root}/_manifest")
    remove_temporary(spark, root)
    return spark.read.parquet(f"{root}/_manifest")


def remove_temporary(spark, root: str) -> None:
    """Removes what attempts that failed have left; all tasks are done."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/.tmp-*")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(target) or []:
        fs.delete(found.getPath(), False)


def members(data) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held, unpack, parts = b"", zlib.decompressobj(31), []
    while held or (held := data.read(1 << 20)):
        parts.append(unpack.decompress(held))
        held = b""
        if unpack.eof:
            yield b"".join(parts)
            held, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parsed(data: bytes) -> dict | None:
    """A response or revisit; None for other kinds."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and same_digest(hashlib.sha1(block), told) is False:
        raise ValueError(f"{fields.get('warc-record-id')}: the block has another digest")
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    sha, told = hashlib.sha1(payload), fields.get("warc-payload-digest", "")
    length = fields.get("warc-payload-length")
    if kind == "response" and (told.startswith("sha1:") and not same_digest(sha, told) or length not in (None, str(len(payload)))):
        raise ValueError(f"{fields.get('warc-record-id')}: the payload has another digest")
    size = int(length) if length is not None else len(payload) if kind == "response" else None
    digest = sha.hexdigest() if kind == "response" else told.removeprefix("sha1:") or None
    return {"page_id": ident(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ident(fields.get("warc-refers-to")) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def same_digest(sha, told: str) -> bool:
    """Whether a sha1: digest, in hex or base 32, is that of the hash."""
    told = told.removeprefix("sha1:")
    return told.lower() == sha.hexdigest() or told.upper() == base64.b32encode(sha.digest()).decode()


def ident(name: str | None) -> int | None:
    """The page id of a name that this writer gave."""
    m = re.fullmatch(r"<urn:page:(-?\d+):.*>", name or "")
    return int(m[1]) if m else None


def read_archive(manifest: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest names; payload adds the responses' bytes."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    types = dict(zip(["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(root)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as data:
                    for member in members(data):
                        found = parsed(member)
                        if found is None:
                            continue
                        rows.append(found)
                        seen += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file}: {seen} records, {records} in the manifest")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

    files = manifest.select("file", "records")
    n = max(1, min(4096, files.count()))
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    return files.repartition(n, "file").mapInArrow(run, schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = scratch(spark, "warc")
    return read_archive(write_archive(pages, root), root).drop("url")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM h
"""
