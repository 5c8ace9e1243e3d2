"""Writing web pages as WARC archives, and reading them.

Records are sorted by page_id and dealt to shards by exact counts of id ranges, so the
archives do not depend on how Spark split the input. Each record is a gzip member of its own; a
file is closed once its compressed size reaches ``roll_bytes``. Headers and digests are
made anew from the payload. Files appear under their names only when whole, and a manifest
written by a Spark job lists them; readers open what the manifest lists.

A null html is an empty payload, and empty payloads count as equal. Of equal payloads of
at least ``revisit_bytes`` the record with the largest page_id is the response; the others
are revisits of it, rows with a null id and all but the first of repeated rows too. Very
long pages are one record. An empty table makes no archive. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, scratch, table, written
from .files import attempt, committed, store

ROLL_BYTES = 64 << 20
SHARD_ROWS = 5_000
RANGES = 4096
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool, nth: int = 0) -> bytes:
    """One WARC/1.1 record. A revisit keeps length and digest of the payload, not its bytes."""

    def urn(of) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {of}')}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {urn(f'{page_id} {nth}' if nth else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if revisits is not None:
            head += [f"WARC-Refers-To: {urn(revisits)}", f"X-Refers-To-Page-Id: {revisits}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """A gzip member without time or name: equal records give equal bytes."""
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _dealt(pages: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Adds ``shard``, in order of page_id, about ``shard_rows`` rows each, however the ids are spread:
    the bounds are quantiles of the ids, at most RANGES of them. Equal ids are in one shard."""
    total = pages.agg(F.count("page_id")).head()[0]
    parts = min(RANGES, -(-total // shard_rows))
    if parts < 2:
        return pages.withColumn("shard", F.lit(0)), 1
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    bounds = sorted(set(pages.agg(F.percentile_approx("page_id", shares, 20 * parts + 10_000)).head()[0]))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    passed = F.size(F.filter(listed, lambda b: b < F.col("page_id")))
    return pages.withColumn("shard", F.when(F.col("page_id").isNull(), 0).otherwise(passed)), len(bounds) + 1


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest (file, records, bytes, sha1)."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    copies = pages.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    copies = written(copies.where("n > 1").select("digest", "newest"), "copies")
    with_shard, shards = _dealt(pages.select("page_id", "url", "html", "digest"), shard_rows)
    dealt = with_shard.join(copies.withColumn("copied", F.lit(True)), "digest", "left").drop("digest")
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        mine, files = attempt(), []
        current, number, members, held, records = None, 0, [], 0, 0
        previous, nth = (object(), None), 0

        def close():
            nonlocal members, held, records, number
            if records:
                name = f"part-{current:05d}-{number:04d}.warc.gz"
                digest = hashlib.sha1()
                with committed(system, path, name, mine) as out:
                    for m in members:
                        out.write(m)
                        digest.update(m)
                files.append((name, records, held, digest.hexdigest()))
            members, held, records, number = [], 0, 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != current:
                    if current is not None:
                        close()
                    current, number = row["shard"], 0
                payload = row["html"].encode()
                same = (row["page_id"], payload)
                nth = nth + 1 if same == previous else 0
                previous = same
                revisit = bool(row["copied"]) and (row["page_id"] != row["newest"] or nth > 0)
                member = gzipped(record(row["page_id"], row["url"], payload, row["newest"], revisit, nth))
                members.append(member)
                held, records = held + len(member), records + 1
                if held >= roll_bytes:
                    close()
        if current is not None:
            close()
        columns = list(zip(*files)) or [[]] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "records", "bytes", "sha1"])

    manifest = map_arrow(dealt.select("page_id", "url", "html", "newest", "copied", "shard"), run, "file string, records long, bytes long, sha1 string")
    manifest.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip stream, one member in memory at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    rest = b""
    while chunk := rest or stream.read(1 << 20):
        parts.append(unpacker.decompress(chunk))
        rest = unpacker.unused_data
        if unpacker.eof:
            data, parts, unpacker = b"".join(parts), [], zlib.decompressobj(31)
            head, _, block = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines[1:])
            yield headers, block[: int(headers["Content-Length"])]
    if parts and b"".join(parts):
        raise ValueError("the archive ends inside a record")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the listed archives: (page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to). Blocks that do not match their digest are errors."""
    names = manifest.select("file").repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        fields = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in parse(stream):
                        if base32_sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block does not match its digest")
                        kind = head["WARC-Type"]
                        payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"{name}: a payload does not match its digest")
                        number = lambda key: int(head[key]) if key in head else None
                        rows.append((number("X-Page-Id"), head["WARC-Target-URI"], payload, number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id")))
                        held += len(block)
                        if held > 4 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return map_arrow(names, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: What reading the archives back must give. SHA-1 hex digits are spelled in base 32, five bits a character.
SQL = """
WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS p FROM pages),
hashed AS (SELECT page_id, url, strlen(p)::BIGINT AS n, sha1(p) AS h FROM payloads),
newest AS (SELECT h, max(page_id) AS m FROM hashed GROUP BY h),
digits AS (SELECT h, list_transform(range(40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS d FROM newest),
bits AS (SELECT h, list_transform(range(160), lambda i: (d[i // 4 + 1] >> (3 - i % 4)) & 1) AS b FROM digits),
spelled AS (SELECT h, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  (16 * b[5 * i + 1] + 8 * b[5 * i + 2] + 4 * b[5 * i + 3] + 2 * b[5 * i + 4] + b[5 * i + 5] + 1)::INT]), '') AS s FROM bits)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to, url
FROM hashed JOIN newest USING (h) JOIN spelled USING (h)"""
