"""A deterministic sharded WARC writer, and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh_path, partitions, read, written

#: Least bytes of payload and headers of a shard, and most shards; the part of that after which a file is closed (compressed bytes).
SHARD_BYTES, MOST_SHARDS, FILES = 8 << 20, 1 << 16, 8
#: What a record counts besides its payload; pages of a cell of the sort; least payload that may be a revisit; compression level.
HEAD_BYTES, CELL_PAGES, REVISIT_FROM, LEVEL = 512, 1 << 18, 0, 6
DATE = "2024-01-01T00:00:00Z"  # records carry no time in the table; a fixed one keeps archives the same
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Whatever store pyarrow knows by the folder's scheme; plain paths and file: are the shared disk."""
    if uri.startswith("file:") or "://" not in uri:
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _one_line(x: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in x or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, n: int) -> bytes:
    """One gzip member. Ids are derived from page_id and digest, so a rerun gives the same bytes."""
    name = lambda p, d=digest: f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{p}:{d}'.encode()).digest()[:16])}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"] if revisit else []),
        f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _write(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        attempt = uuid.uuid4().hex[:12]
        done: list[tuple[str, str, int, int, str]] = []
        out, final, temp, size, rows, sha, shard, part, last = None, "", "", 0, 0, None, None, 0, None

        def close() -> None:
            if out is not None:
                out.close()
                done.append((final, temp, rows, size, sha.hexdigest()))

        for batch in batches:
            for kind, s, page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:  # what was decided for the rows of this page_id and digest, ahead of them
                    last = (page_id, digest, refers_to)
                    continue
                if s != shard or size >= roll:
                    close()
                    part = part + 1 if s == shard else 0
                    shard = s
                    final, temp = f"pages-{s:010d}-{part:05d}.warc.gz", f"_temporary/pages-{s:010d}-{part:05d}.{attempt}"
                    out, size, rows, sha = fs.open_output_stream(f"{base}/{temp}", compression=None), 0, 0, hashlib.sha256()
                to = last[2] if last and last[:2] == (page_id, digest) else None
                payload = (html or "").encode()
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page_id, url, payload, b32, to, to is not None, len(payload))
                out.write(data)
                sha.update(data)
                size, rows = size + len(data), rows + 1
        close()
        cols = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "temp", "records", "bytes", "sha256"])

    return run


def _publish(root: str):
    """Gives files their names, and passes on their lines of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        for batch in batches:
            for name, temp, size in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                try:
                    fs.move(f"{base}/{temp}", f"{base}/{name}")
                except OSError:  # an attempt that was lost after it may have named the file
                    found = fs.get_file_info(f"{base}/{name}")
                    if found.type != pafs.FileType.File or found.size != size:
                        raise
            yield batch.select(["file", "records", "bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, shard_bytes: int | None = None, roll: int | None = None, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under root and returns the manifest: file, records, bytes,
    sha256, in no order.

    Records are sorted by (page_id, payload's digest) over the whole table, nulls first, and cut into shards of about shard_bytes of payload (SHARD_BYTES,
    or what makes MOST_SHARDS of the table); a shard is written by one task, which closes a file once it has `roll` compressed bytes (shard_bytes /
    FILES). The cuts come from exact running sums over the table of ids, so names and bytes depend on the rows alone and not on how Spark deals
    them; sparse, null or repeated page_ids make no difference to the shards' sizes. Only rows equal in page_id and payload stay together. Pages
    with their html move once. The table of cuts, which each task gets whole, has MOST_SHARDS rows at most.

    Each task writes to temporary names with its own attempt in them; a first manifest, which only a complete job has, says which attempt counts.
    A second job gives these files their names and writes the manifest, which is there only once all have them; a task
    of it that runs again finds its files named. What a lost task left is deleted with the temporary folder.

    Equal payloads (by SHA-1) of revisit_from bytes or more: the one of largest page_id is the response, the others
    revisit it; of rows that repeat that page_id all are responses. Null html: empty payload. Null page_id: first in order,
    never the response of others unless all copies have null ids. Null url: empty. No rows: a manifest without files.
    Columns besides these three are not read.
    """
    spark = pages.sparkSession
    bytes_ = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(bytes_).alias("digest"), F.octet_length(bytes_).alias("n"))
    ids = written(p.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")), "warc-ids")
    weight = ((F.col("n") + HEAD_BYTES) * F.col("rows")).cast("long")
    rows_, total = ids.agg(F.count(F.lit(1)), F.sum(weight)).first()  # one row
    shard_bytes = shard_bytes or max(SHARD_BYTES, -(-(total or 0) // MOST_SHARDS))
    roll = roll or max(1, shard_bytes // FILES)
    cuts = _cuts(ids.withColumn("weight", weight), shard_bytes, max(partitions(spark), rows_ // CELL_PAGES))
    n = cuts.agg(F.max("n_shards")).first()[0] or 1
    best = ids.filter(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("rows").alias("n")).filter("n > 1").drop("n")
    decided = ids.filter(F.col("n") >= revisit_from).join(best, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    none = F.lit(None).cast("string")
    rows = decided.select(F.lit(0).alias("kind"), "page_id", none.alias("url"), none.alias("html"), "digest", "refers_to").union(
        p.select(F.lit(1).alias("kind"), "page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to")))
    rows = rows.crossJoin(F.broadcast(cuts.drop("n_shards"))).withColumn("shard", _place("cuts", F.struct("page_id", "digest"))).select("kind", "shard", "page_id", "url", "html", "digest", "refers_to")  # by one row
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    fs, base = _driver_fs(spark, root)
    fs.mkdirs(base(f"{root}/_temporary"))
    files = dealt.mapInArrow(_write(root, roll), "file string, temp string, records long, bytes long, sha256 string")
    files.write.parquet(f"{root}/_temporary/manifest")  # Spark's own commit decides which attempts count
    done = spark.read.schema(files.schema).parquet(f"{root}/_temporary/manifest")
    manifest = done.repartition(partitions(spark), "file").mapInArrow(_publish(root), MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    fs.delete(base(f"{root}/_temporary"), True)
    return spark.read.schema(manifest.schema).parquet(f"{root}/manifest")


def _cuts(ids: DataFrame, shard_bytes: int, cells: int) -> DataFrame:
    """One row: cuts, the first (page_id, digest) of each shard in their order, and n_shards. Where Spark's range partitions end doesn't matter: their
    sums give the exact running sum of each row."""
    key = [F.col("page_id").asc_nulls_first(), F.col("digest").asc()]
    rows = written(ids.repartitionByRange(cells, *key).select("page_id", "digest", "weight", F.spark_partition_id().alias("cell")), "warc-order")
    cell = rows.groupBy("cell").agg(F.sum("weight").alias("in_cell"))
    cell = cell.select("cell", F.coalesce(F.sum("in_cell").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each cell
    own = F.sum("weight").over(W.partitionBy("cell").orderBy(*key).rowsBetween(W.unboundedPreceding, 0))
    at = rows.withColumn("own", own).join(cell, "cell").select("page_id", "digest", F.expr(f"(before + own - weight) div {shard_bytes}").alias("part"))
    first = at.groupBy("part").agg(F.min(F.struct("page_id", "digest")).alias("first"))  # null ids are the least
    return written(first.agg(F.array_sort(F.collect_list("first")).alias("cuts"), F.count(F.lit(1)).cast("int").alias("n_shards")), "warc-cuts")


def _place(cuts: str, key: Column) -> Column:
    """The last place (from 0) of `cuts` that is no greater than the key, found by halving."""
    steps = F.array(*[F.lit(MOST_SHARDS >> i) for i in range(MOST_SHARDS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < F.size(cuts)) & (F.get(F.col(cuts), at + step) <= key), at + step).otherwise(at))


def _driver_fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream, which is read record by record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a record is cut short")
        yield head, block


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    for head, block in parse(gzip.GzipFile(fileobj=raw)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = head["warc-payload-digest"].partition(":")[2], head["warc-type"]
                        if base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"].partition(":")[2]:
                            raise ValueError(f"{name}: block digest of {head['warc-record-id']}")
                        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: payload digest of {head['warc-record-id']}")
                        number = lambda k: int(head[k]) if head.get(k) else None
                        rows.append((number("x-page-id"), n, digest, kind, number("x-refers-to-page"), head["warc-target-uri"], payload.decode() if kind == "response" else None))
                        if len(rows) >= 256:
                            yield _batch(rows)
                            records -= len(rows)
                            rows = []
                records -= len(rows)
                if records:
                    raise ValueError(f"{name}: {records} records are missing")
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_warc(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, digests and counts verified: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, payload (null for revisits)."""
    files = manifest.select("file", "records")
    return files.repartition(partitions(spark), "file").mapInArrow(_read(root), f"{PAGE}, url string, payload string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    manifest = write_warc(read(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, manifest).drop("url", "payload")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages
), b AS (SELECT *, list_reduce(list_transform(string_split(regexp_replace(d, '(.)', '\\1 ', 'g'), ' ')[:40], lambda x: lpad(bin(('0x' || x)::INT), 4, '0')), lambda a, x: a || x) AS bits FROM p
), e AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('{_B32}', (('0b' || substr(bits, (i * 5 + 1)::INT, 5))::INT + 1), 1)), '') AS digest,
    max(page_id) OVER (PARTITION BY t) AS best FROM b
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM e
"""

QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": OP4_SQL}
