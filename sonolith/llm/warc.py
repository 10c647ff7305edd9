"""WARC archives: deterministic sharded writer and reader.

Records are sorted by range of page_id, so every task writes a run of the order, and files roll by compressed size.
Headers, record ids and digests come from the rows alone: two runs, or two attempts of a task, write equal bytes. Files
appear under temporary names, are renamed when whole, and the manifest that names them is written last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .files import TaskFile, open_stream

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sonolith:warc")
#: Compressed size at which a file is closed.
ROLL_BYTES = 256 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha256: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{sha256}|{copy}')}>"


def _one_line(text: str) -> str:
    """A header value: control characters and spaces percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in text)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, sha256: str, date: str, refers_to: tuple | None, copy: int = 0) -> bytes:
    """A response with its HTTP head and payload, or a revisit (refers_to holds the response's page_id) without the latter."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha256, copy)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha256))]
        if refers_to[0] is not None:
            headers.append(("X-Refers-To-Page-ID", str(refers_to[0])))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    return _record(headers, http if refers_to is not None else http + payload)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z", shards: int | None = None) -> DataFrame:
    """Write one record per row in ascending page_id and return the manifest (file, records, bytes, sha256).

    The manifest is written last, to ``manifest`` in the folder; read_manifest() finds it there. With ``shards`` file
    boundaries don't depend on the session's number of partitions. page_id must be of an integer type.

    Of rows with equal payloads of least_bytes at least, the one with the smallest page_id becomes the response and the
    others revisit it; null ids come last there. Only ids and digests are grouped; they meet the pages again as rows of
    the same sort, so a page is shuffled once.
    """
    if dict(pages.dtypes)[page_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{page_id} must be of an integer type")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    narrow = C.materialize(rows.filter(F.length("payload") >= least_bytes).select("page_id", "sha256"), "digests")
    groups = narrow.groupBy("sha256").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = C.join_groups(narrow, groups.filter("copies > 1"), "sha256", "copies", narrow.count())
    later = joined.filter("copies > 1 AND NOT page_id <=> first").select("page_id", "sha256", "first").distinct()
    refs = later.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha256", F.lit(0).alias("kind"), "first")
    body = rows.withColumn("kind", F.lit(1)).withColumn("first", F.lit(None).cast("long"))
    both, order = refs.unionByName(body), ("page_id", "sha256")
    both = both.repartitionByRange(shards, *order) if shards else both.repartitionByRange(*order)
    ordered = both.sortWithinPartitions("page_id", "sha256", "kind", "url")

    def run(batches):
        part, out, made, last, refers, copy = TaskContext.get().partitionId(), None, 0, None, None, 0
        records = 0

        def close():
            nonlocal out, made, records
            out.commit()
            row = [[out.name], [records], [out.size], [out.sha256]]
            out, made, records = None, made + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file", "records", "bytes", "sha256"])

        for batch in batches:
            for piece in C.pieces([batch]):
                for row in piece.to_pylist():
                    key = row["page_id"], row["sha256"]
                    if row["kind"] == 0:
                        last, refers, copy = key, (row["first"],), 0
                        continue
                    if key != last:
                        last, refers, copy = key, None, 0
                    if out is None:
                        out = TaskFile(folder, f"pages-{part:06d}-{made:05d}.warc.gz")
                        info = b"software: sonolith\r\nformat: WARC File Format 1.1\r\n"
                        name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, out.name)}>"
                        out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], info))
                    equal = len(row["payload"]) >= least_bytes and copy
                    target = refers if refers is not None else ((row["page_id"],) if equal else None)
                    out.write(page_record(row["page_id"], row["url"], row["payload"], row["sha256"], date, target, copy))
                    records, copy = records + 1, copy + 1
                    if out.size >= roll_bytes:
                        yield close()
        if out is not None:
            yield close()

    ordered.mapInArrow(run, "file string, records long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of an archive folder: only files that it names are part of the archive."""
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20):
    """The contents of a file's gzip members one by one."""
    inflate, held = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            held.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(held)
                inflate, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the last gzip member is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block), with the block's length and digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"digest of {headers['warc-record-id']}")
    return headers, block


def read(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Per record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to; with
    ``payload`` also url and the payload of responses.

    Files are streamed record by record; digests of blocks and payloads are recomputed and must agree.
    """

    def rows(name):
        with open_stream(folder, name) as stream:
            for record in members(stream):
                headers, block = parse(record)
                kind = headers["warc-type"]
                if kind == "warcinfo":
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                size = int(http.decode().split("Content-Length: ")[1])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']}")
                number = (int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page-id"))
                one, two = number
                yield (one, size, digest, kind, two, *((headers.get("warc-target-uri"), body if kind == "response" else None) if payload else ()))

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payload else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if payload else [])]

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for row in rows(name):
                    held.append(row)
                    if len(held) >= (64 if payload else 4096):
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload
    # a manifest row is small but stands for a whole file, so partitions are counted in files, not bytes
    return manifest.select("file").repartition(max(1, min(manifest.count(), 20_000)), "file").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """write() to a new shared folder, then read().

    A null html is an empty payload; null urls and ids have no header. Of repeated rows the first is the response. An
    empty table writes no file and gives an empty result.
    """
    folder = C.scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder)
