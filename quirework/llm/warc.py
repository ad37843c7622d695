"""WARC archives: a writer that marks repeated payloads as revisits, and a splittable reader.

Writing: records are one gzip member each. Of records with equal payloads of at
least ``min_bytes``, the one with the smallest id holds the payload and the others
are revisits of it. Each task writes files of its own names and reports them; the
table of the reported files is the manifest, so files of failed or repeated
attempts are never read.

Reading: a task gets a byte range, looks for gzip magic from its start, and takes a
place for a member only if it decodes, begins with a WARC header, has the length that
the header says and is followed by another member or the end. From there it goes
member by member, and owns those that start inside its range.

Null payloads are empty, null urls leave out the header, a null id has an empty
record id and comes back as null. Rows that share the smallest id of a payload all hold it.
Payloads are read whole, one record at a time.
"""

from __future__ import annotations

import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm._shared import join_counted, scratch_path, small_batches, stored

MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "path string, offset bigint, record_type string, record_id string, target_uri string,"
    " payload_digest string, payload_bytes bigint, refers_to string, payload binary"
)


def _line(value: str) -> str:
    """A header value: control characters and line ends are percent-encoded."""
    return "".join(c if c.isprintable() else urllib.parse.quote(c) for c in value)


def record_bytes(record_id: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-record:{record_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: <urn:x-record:{refers_to}>", f"WARC-Profile: {_REVISIT}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def write_warc(
    pages: DataFrame,
    directory: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 100,
    file_bytes: int = 256 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archives; returns the manifest (path, bytes, records)."""
    directory = directory or scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = stored(rows.filter(F.col("size") >= min_bytes).select("id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")).filter("times > 1 AND first IS NOT NULL")
    later = join_counted(narrow, first, "digest", narrow.count()).filter(~F.col("first").eqNullSafe(F.col("id"))).distinct()
    later = later.select(F.col("digest").alias("of"), F.col("id").alias("by"), "first")
    # payloads move by digest and id, so a page that stands often isn't one task's
    joined = rows.join(later, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("by")), "left")
    again = F.col("first").isNotNull()
    out = joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first").cast("string")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(directory)
        files.create_dir(base, recursive=True)
        sink, name, size, records = None, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{directory}/{name}"], "bytes": [size], "records": [records]})

        for batch in batches:
            for row in (r for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)) for r in part.to_pylist()):
                if sink is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{base}/{name}", compression=None)
                refers = None if row["refers_to"] is None else urllib.parse.quote(row["refers_to"], safe="")
                data = record_bytes(urllib.parse.quote(row["id"], safe=""), row["url"], (row["payload"] or "").encode(), row["size"], row["digest"], refers, date)
                sink.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    yield from close()
                    sink = None
        if sink is not None:
            yield from close()

    return stored(out.mapInArrow(write, "path string, bytes bigint, records bigint"), "manifest")


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class Members:
    """The gzip members of an archive, by offset."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, max(0, self.size - at)))

    def decode(self, at: int) -> tuple[bytes, int] | None:
        """The member at ``at`` and the offset after it; None if none starts there."""
        engine, parts, place = zlib.decompressobj(31), [], at
        try:
            while not engine.eof:
                block = self.read(place, _BLOCK)
                if not block:
                    return None
                place += len(block)
                parts.append(engine.decompress(block))
                if place - len(block) == at and parts[0] and not parts[0].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        return b"".join(parts), place - len(engine.unused_data)

    def record(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Header, block and next offset of the record whose member starts at ``at``."""
        if self.read(at, 3) != MAGIC or (found := self.decode(at)) is None:
            return None
        data, after = found
        head, cut, rest = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        length = headers.get("content-length", "")
        if not data.startswith(b"WARC/1.") or not cut or not length.isdigit() or "warc-type" not in headers or len(rest) != int(length) + 4:
            return None
        if after < self.size and self.read(after, 3) != MAGIC:
            return None
        return headers, rest[: int(length)], after

    def between(self, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """The records that start in [start, end)."""
        at, found = start, None
        while at < end and found is None:  # candidates for the first member
            window = self.read(at, min(_BLOCK, end - at) + 2)
            k = window.find(MAGIC)
            if k < 0:
                at += max(1, len(window) - 2)
                continue
            found = self.record(at + k) if at + k < end else None
            at += k if found else k + 1
        while found is not None:
            headers, block, after = found
            yield at, headers, block
            at = after
            if at >= min(end, self.size):
                return
            found = self.record(at)
            if found is None:
                raise ValueError(f"no record at byte {at}")


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives in ``files`` (path, bytes), in byte ranges of ``split_bytes``."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = splits.repartition(int(min(tasks, 20_000)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
        )

        def name(urn: str | None) -> str | None:
            return None if urn is None else urllib.parse.unquote(urn.strip("<>").removeprefix("urn:x-record:"))

        for batch in batches:
            for split in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(split["path"])
                with files.open_input_file(path) as source:
                    rows, held = [], 0
                    for offset, headers, block in Members(source, split["bytes"]).between(split["start"], split["start"] + split_bytes):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
                        size = int(_headers(head).get("content-length", len(payload))) if kind == "revisit" else len(payload)
                        rows.append((split["path"], offset, kind, name(headers.get("warc-record-id")), headers.get("warc-target-uri"), digest.rpartition(":")[2], size, name(headers.get("warc-refers-to")), payload if kind != "revisit" else None))
                        held += len(payload)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return splits.mapInArrow(read, RECORD)
