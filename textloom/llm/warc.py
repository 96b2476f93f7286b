"""Operator 4, WARC: writing archives, normalising monolithic gzip, and reading by offset.

Writers produce one gzip stream per file, as many crawlers do. The normaliser inflates such a stream once, from front to end
in bounded memory, rewrites every record as a gzip member of its own, and writes a sidecar index (JSON lines of offset, length,
record id). With it, records are read one at a time from their offsets, by as many tasks as there are ranges.

Files lie in the shared folder and are reached by pyarrow's file systems. A task writes under a name of its attempt and
renames when done, so a lost or repeated attempt leaves no half file in place.

Equal payloads are found by SHA-1: the page of the largest id is the response, all others are revisits of it and carry no
payload. Only digests are shuffled by payload; pages are dealt by id and digest, so a payload that a third of all
pages share does not meet in one task. Pages without an id are dealt by their address too.

Defined results: a null html is an empty payload; empty payloads are like any others. A null page_id is written as an
empty field and read back as null; it counts as smaller than any id. Of rows equal in page_id and payload, one is written as
the response (if they are it) and the others revisit it. The target address is percent-encoded; where that changes it, or it is null
(`urn:none`) or empty, a field of its own keeps it. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._common import cut, lean, read, scratch, slices

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: What an address holds as it is: printable ASCII but the blank.
PRINTED = "".join(map(chr, range(33, 127)))
#: Groups, by address, of pages without an id.
NO_ID_GROUPS = 256
#: Smallest payload, in bytes, that another may revisit.
MIN_PAYLOAD = 0
#: Bytes of archive that one read task takes.
RANGE_BYTES = 32_000_000
CHUNK = 1 << 20

INDEX = "file string, offset long, length long, record_id string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _publish(path: str, write) -> None:
    """Has write(stream) fill a file that appears under its name only when whole."""
    system, name = _open(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        write(out)
    system.move(part, name)


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with its closing blank lines."""
    key = "" if page_id is None else str(page_id)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key} {copy} {digest}")
    target = quote(url, safe=PRINTED) if url else "urn:none"
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-Page-ID: {key}"]
    if target != url:
        head.append(f"X-Original-Address: {json.dumps(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + CRLF + CRLF + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + body + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of one record; checks the payload of a response against its digest."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(CRLF + CRLF)[2]
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return fields, payload


def plan_records(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, digest, copy, revisit, refers_to: how each page is to be written."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha", F.sha1("payload")).withColumn("part", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(NO_ID_GROUPS))).otherwise(0))
    pages = pages.withColumn("key", F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "part"))
    small = pages.select("key", "sha").groupBy("key", "sha").agg(F.count(F.lit(1)).alias("copies"))
    top = small.groupBy("sha").agg(F.max("key").alias("top"))
    roles = small.join(top, "sha").select(F.col("key.known").alias("known"), F.coalesce("key.page_id", F.lit(0)).alias("id"), F.col("key.part").alias("part"), "sha", "top")
    pages = pages.withColumn("known", F.col("key.known")).withColumn("id", F.coalesce("page_id", F.lit(0)))
    copy = F.row_number().over(Window.partitionBy("id", "known", "part", "sha").orderBy("url")) - 1
    got = pages.withColumn("copy", copy).join(roles, ["id", "known", "part", "sha"])
    alone = F.octet_length("payload") < least
    revisit = ~alone & (~F.col("key").eqNullSafe(F.col("top")) | (F.col("copy") > 0))
    return got.select("page_id", "url", "payload", "sha", (F.col("part") * F.lit(1 << 40) + F.col("copy")).cast("long").alias("copy"), revisit.alias("revisit"), F.when(revisit, F.col("top.page_id")).alias("refers_to"))


def write_monolithic(planned: DataFrame, folder: str) -> DataFrame:
    """Writes each partition as one gzip stream of records; (file, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0

        def fill(out) -> None:
            nonlocal n
            with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as stream:
                for batch in slices(batches, column="payload"):
                    for page_id, url, payload, sha, copy, revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "copy", "revisit", "refers_to")), strict=True):
                        digest = base64.b32encode(bytes.fromhex(sha)).decode()
                        stream.write(record(page_id, copy, url, payload, len(payload), digest, refers_to, revisit))
                        n += 1

        first = next(batches, None)
        if first is None:
            return
        rest, batches = batches, None
        batches = (b for part in ([first], rest) for b in part)
        _publish(path, fill)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], type=pa.int64())], names=["file", "n"])

    return planned.mapInArrow(lean(run), "file string, n long")


def _inflated(stream, size: int) -> Iterator[bytes]:
    """A gzip stream of one or more members, inflated once, in parts of `size` bytes at most."""
    inflate, data = zlib.decompressobj(31), stream.read(size)
    begun = False
    while data:
        out = inflate.decompress(data, size)
        begun = True
        yield out
        data = inflate.unconsumed_tail
        while not data and not inflate.eof and len(out) == size:  # what it still holds
            out = inflate.decompress(b"", size)
            yield out
        if inflate.eof:
            data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
        data = data or stream.read(size)
    if begun:
        raise ValueError("the stream ends within a member")


def records_of(stream, size: int = CHUNK) -> Iterator[bytes]:
    """The records of a gzip stream, inflated once; holds one record and a part of `size` bytes at a time."""
    held, looked, whole = bytearray(), 0, 0
    for part in _inflated(stream, size):
        held += part
        while True:
            if not whole:
                if (end := held.find(CRLF + CRLF, looked)) < 0:
                    looked = max(0, len(held) - 3)
                    break
                mark = held.rfind(b"Content-Length: ", 0, end) + 16
                whole = end + 4 + int(held[mark:end].split(CRLF)[0]) + 4
            if whole > len(held):
                break
            yield bytes(held[:whole])
            del held[:whole]
            looked = whole = 0
    if held.strip():
        raise ValueError("the stream ends within a record")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites monolithic files (column file) with a member per record and a sidecar index; the index as rows (INDEX)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                path = f"{folder}/{file.rpartition('/')[2]}"
                found: list[tuple[int, int, str]] = []
                system, name = _open(file)

                def fill(out) -> None:
                    at = 0
                    with system.open_input_stream(name, compression=None) as stream:
                        for raw in records_of(stream):
                            member = gzip.compress(raw, 6, mtime=0)
                            mark = raw.find(b"WARC-Record-ID: ") + 16
                            found.append((at, len(member), raw[mark : raw.find(CRLF, mark)].decode()))
                            out.write(member)
                            at += len(member)

                _publish(path, fill)
                lines = "".join(json.dumps({"offset": o, "length": n, "record_id": r}) + "\n" for o, n, r in found)
                _publish(f"{path}.idx", lambda out: out.write(lines.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([o for o, _, _ in found], type=pa.int64()), pa.array([n for _, n, _ in found], type=pa.int64()), pa.array([r for _, _, r in found])], names=["file", "offset", "length", "record_id"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n, "file").mapInArrow(lean(run), INDEX)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) that an index names, each inflated from its own offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != at:
                    system, name = _open(file)
                    at, stream = file, system.open_input_file(name)
                fields, payload = parse(gzip.decompress(stream.read_at(length, offset)))
                number = lambda k: int(fields[k]) if fields.get(k) else None
                url = json.loads(fields["X-Original-Address"]) if "X-Original-Address" in fields else fields["WARC-Target-URI"]
                rows.append((number("X-Page-ID"), url, number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page"), payload if payloads and fields["WARC-Type"] == "response" else None))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES)).repartition(n, "file", "range").sortWithinPartitions("file", "offset")
    return ranges.select("file", "offset", "length").mapInArrow(lean(run), RECORDS)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as archives under `folder`, normalised and indexed; the index, as a stored table."""
    files = cut(write_monolithic(plan_records(pages), f"{folder}/monolithic"), "warc-files")
    index = cut(normalise(files, f"{folder}/members"), "warc-index")
    if files.limit(1).count():
        system, name = _open(f"{folder}/monolithic")
        system.delete_dir(name)  # the normalised copies replace them
    return index


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(read(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL of op4: SHA-1 digests go from hexadecimal to base32 digit by digit.
OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
bits AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top,
    list_aggregate(list_transform(range(0, 40), lambda i: format('{:04b}', cast(strpos('0123456789abcdef', substr(h, cast(i + 1 AS BIGINT), 1)) - 1 AS INTEGER))), 'string_agg', '') AS b FROM d)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * cast(substr(b, cast(5 * i + 1 AS BIGINT), 1) AS BIGINT) + 8 * cast(substr(b, cast(5 * i + 2 AS BIGINT), 1) AS BIGINT) + 4 * cast(substr(b, cast(5 * i + 3 AS BIGINT), 1) AS BIGINT)
        + 2 * cast(substr(b, cast(5 * i + 4 AS BIGINT), 1) AS BIGINT) + cast(substr(b, cast(5 * i + 5 AS BIGINT), 1) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits
"""
