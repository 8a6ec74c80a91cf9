"""WARC archives: writing, and a splittable reader (operator 7).

Every record is a gzip member of its own. Archives are written by Spark's text writer, so that its commit protocol
handles lost executors on any file system: a row is the bytes of one member, and the line separator is an empty gzip
member, which readers of concatenated members pass over.

Reading takes two passes over byte ranges. In the first, a task looks for the gzip magic in its range and decodes what
starts there; a candidate is a member if it inflates to its end with the right checksum. A stored member may embed whole
members, so a candidate is one of the archive only if it lies where the member before it ends. A range can't know that by
itself, but it knows where its chain of members leaves it for any place at which the chain may enter: a step function of
few steps (one, where nothing is embedded). These are composed range by range for each file, which gives every range its
entry. In the second pass a task goes from the entry from member to member, and owns the records whose member starts inside
its range; it follows the last one past the end. After damage, both passes go on with the next candidate.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import by_slice, fresh, shared_path, ship, stored

MAGIC = b"\x1f\x8b\x08"
EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
MOST_BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page)}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit of another record."""
    block = HTTP if refers_to is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {_urn(page if page is not None else f'null {url} {digest}')}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> str:
    """Write a record per row and return the folder of the archives.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is the response and the others
    are revisits. Null payloads are empty. Null ids come after all others and are never referred to: a payload that only
    they have is a response each time. Of rows that repeat id and payload, one is the response. Other columns are ignored.
    """
    spark = ship(pages.sparkSession)
    path = path or shared_path(spark, "warc")
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keyed = base.where(F.octet_length("payload") >= least).groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.max(F.when(F.col("id").isNotNull(), F.col("n"))).alias("most")).where((F.col("n") > 1) & F.col("first").isNotNull())
    few, repeated = first.agg(F.count("*"), F.coalesce(F.max("most") > 1, F.lit(False))).first()
    first = first.select("digest", "first")
    base = base.withColumn("rank", F.lit(1))
    if repeated:  # which of the rows that repeat id and payload comes first
        from pyspark.sql import Window

        base = base.withColumn("rank", F.row_number().over(Window.partitionBy("digest", "id").orderBy("url")))
    base = base.join(F.broadcast(first) if few <= MOST_BROADCAST_ROWS else first, "digest", "left")
    refers = F.when((F.octet_length("payload") >= least) & ~(F.col("id").eqNullSafe(F.col("first")) & (F.col("rank") == 1)), F.col("first").cast("string"))

    def pack(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(c.to_pylist() for c in piece.columns))
        return pa.record_batch([pa.array([record(p, u, b.encode(), base64.b32encode(bytes.fromhex(d)).decode(), r) for p, b, u, d, r in rows], pa.binary())], ["member"])

    members = base.select(F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("payload"), "url", "digest", refers.alias("refers")).mapInArrow(by_slice(pack), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("compression", "none").text(path)
    return path


class Source:
    """Ranged reads of a file: local paths directly, other file systems through Arrow."""

    def __init__(self, path: str, length: int):
        parts = urlparse(path)
        self.length = length
        if parts.scheme in ("", "file"):
            from urllib.parse import unquote

            self.file = open(unquote(parts.path), "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(name)

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(size, self.length - at)))

    def close(self) -> None:
        self.file.close()


def inflate(source: Source, at: int) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and where it ends; None if there is no whole member."""
    unpack, out, size = zlib.decompressobj(31), [], 4096
    try:
        while not unpack.eof:
            data = source.read(at, size)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at, size = at + len(data), READ_BYTES
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def member_end(source: Source, at: int) -> int | None:
    """Where the member at ``at`` ends, without keeping its content; None if there is no whole member."""
    unpack, size = zlib.decompressobj(31), 4096
    try:
        while not unpack.eof:
            data = source.read(at, size)
            if not data:
                return None
            at, size = at + len(data), READ_BYTES
            while data and not unpack.eof:
                unpack.decompress(data, READ_BYTES)
                data = unpack.unconsumed_tail
    except zlib.error:
        return None
    return at - len(unpack.unused_data)


def magics(source: Source, start: int, end: int) -> Iterator[int]:
    """The places of the gzip magic in [start, end)."""
    at = start
    while at < end:
        window, found = source.read(at, min(READ_BYTES, end - at) + len(MAGIC) - 1), -1
        while (found := window.find(MAGIC, found + 1)) >= 0:
            yield at + found
        at += READ_BYTES


def survey(source: Source, start: int, end: int) -> tuple[list[int], list[int]]:
    """The steps (last entry, exit) of the range: a chain that enters at most at the one, and after the step before, leaves at the other."""
    members = [(at, stop) for at in magics(source, start, end) if (stop := member_end(source, at)) is not None]
    starts, exits = [at for at, _ in members], [0] * len(members)
    for k in range(len(members) - 1, -1, -1):
        after = bisect_left(starts, members[k][1])
        exits[k] = exits[after] if after < len(members) else members[k][1]
    last = [k for k in range(len(members)) if k + 1 == len(members) or exits[k] != exits[k + 1]]
    return [starts[k] for k in last], [exits[k] for k in last]


def entries(starts: list[int], steps: list[tuple[list[int], list[int]]]) -> list[int]:
    """Where the chain of members enters each range of a file, in order (in its end, if it passes the range over)."""
    out, at = [], 0
    for start, (last, exits) in zip(starts, steps):
        at = max(at, start)
        out.append(at)
        if (k := bisect_left(last, at)) < len(last):
            at = exits[k]
    return out


def records(source: Source, entry: int, end: int) -> Iterator[bytes]:
    """The contents of the records whose members start in [entry, end); entry is where a member ends, or the next one is to be looked for."""
    at = entry
    while at < end:
        for candidate in magics(source, at, end):
            if (member := inflate(source, candidate)) is not None:
                break
        else:
            return
        content, at = member
        if content.startswith(b"WARC/"):
            yield content


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of a record (names in lower case) and its payload, without the HTTP header."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[: int(fields.get("content-length", len(rest)))]
    return fields, block.partition(b"\r\n\r\n")[2]


def read(spark: SparkSession, path: str, id_type: T.DataType | str = "bigint", split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest (base32 SHA-1), refers_to, payload.

    Lengths and digests of responses are computed from the payload that was read and must agree with the record's
    fields; revisits carry those of the response. An empty folder gives no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"))
    parts = min(max(1, ranges.count()), 100_000)

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                source = Source(row["path"], row["length"])
                last, exits = survey(source, row["start"], min(row["start"] + split_bytes, row["length"]))
                source.close()
                yield pa.record_batch([pa.array([row[c]], t) for c, t in (("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()))] + [pa.array([x], pa.list_(pa.int64())) for x in (last, exits)], ["path", "length", "start", "last", "exits"])

    def enter(own: pa.Table) -> pa.Table:
        own = own.sort_by("start")
        found = entries(own["start"].to_pylist(), list(zip(own["last"].to_pylist(), own["exits"].to_pylist())))
        return pa.table([own["path"], own["length"], own["start"], pa.array(found, pa.int64())], ["path", "length", "start", "entry"])

    steps = ranges.repartition(parts, "path", "start").mapInArrow(fresh(look), "path string, length bigint, start bigint, last array<bigint>, exits array<bigint>")
    placed = stored(steps.groupBy("path").applyInArrow(enter, "path string, length bigint, start bigint, entry bigint"), "ranges")
    ranges = placed.where(F.col("entry") < F.least(F.col("start") + split_bytes, "length")).repartition(parts, "path", "start")

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                source, rows, held = Source(row["path"], row["length"]), [], 0
                for content in records(source, row["entry"], min(row["start"] + split_bytes, row["length"])):
                    fields, payload = parse(content)
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or len(payload) != size:
                            raise ValueError(f"damaged record {fields['warc-record-id']} in {row['path']}")
                        digest, size = own, len(payload)
                    rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), kind, size, digest, fields.get("x-refers-to-page"), payload.decode() if keep_payload and kind == "response" else None))
                    held += len(payload)
                    if held > READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                source.close()
                yield _batch(rows)

    out = ranges.mapInArrow(fresh(scan), "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, columns)], names)
