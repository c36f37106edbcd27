"""WARC archives: a writer with a gzip member for each record, and a splittable reader.

The reader deals byte ranges of the archives to tasks. A task looks for gzip's magic bytes in its range, and takes
a place as a record only if a member starts there whose decoded start is a whole WARC header; it then owns that
record, however far beyond the range it reaches, and goes on behind it. A record that started in an earlier range
belongs to that range's task: its bytes here hold no member that decodes to a WARC header. (A payload that is itself
an archive, stored by the compressor as it is, could hold one; texts can't, as 1F 8B is not UTF-8.)
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import local_or_uri, need, scratch, table, written

SPLIT = 64 << 20
ROLL = 1 << 30
MIN_BYTES = 0
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
OUT_BYTES = 8 << 20
FIELDS = "file string, offset bigint, page_id bigint, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def base32_of(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _name(page_id) -> str:
    return f"<urn:sparkloom:page:{'' if page_id is None else int(page_id)}>"


def _page(name: str | None):
    digits = (name or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def _clean(url: str) -> str:
    """Control characters and spaces, which would end or split a header line, are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, roll: int = ROLL) -> DataFrame:
    """Writes a record per row to archives under path; returns a written manifest (file, bytes, records).

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least min_bytes bytes those
    with the smallest id are responses (repeated rows all are), the others revisit that id; a null id counts as the
    largest. A null url has no target line. An empty table writes no file. Other columns are ignored. Each attempt of a task writes files of its own
    and only files that the manifest names count, so a lost executor or a second attempt leaves nothing that is read.
    """
    need(pages, page_id, url, html)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256)})
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1", "sha2").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # written first, so that adaptive execution can split the rows of a hot digest
    rows = rows.join(written(first, "first"), ["sha1", "sha2"], "left").select("page_id", "url", "payload", "sha1", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = local_or_uri(path)
        task = TaskContext.get()
        stem = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, done, name, size, count = None, [], "", 0, 0
        for batch in batches:
            for page, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, size, count = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = record(page, url, payload, base32_of(sha1), first, first is not None and page != first)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll:
                    out.close()
                    out = None
                    done.append((path + name[len(base):], size, count))
        if out is not None:
            out.close()
            done.append((path + name[len(base):], size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "bytes", "records"), x, strict=True)) for x in done], pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return written(rows.mapInArrow(write, "file string, bytes bigint, records bigint"), "manifest")


class _Window:
    """Bytes of a file by their offset, read ahead in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + min(n, self.size - offset) <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(n, READ))
        return self.data[offset - self.at : offset - self.at + n]


def header_at(window: _Window, offset: int):
    """(header fields, first byte behind the header) if a member with a WARC header starts here, else None.

    A header is read to its blank line, however long it is; one that the file's end cuts raises.
    """
    z, text, at = zlib.decompressobj(31), bytearray(), offset
    while at < window.size and not z.eof:
        piece = window.get(at, 4096)
        at += len(piece)
        seen = max(0, len(text) - 3)
        try:
            text += z.decompress(piece)
        except zlib.error:
            if text.startswith(b"WARC/"):
                raise ValueError(f"the header of the record at {offset} is damaged") from None
            return None
        if text[:5] != b"WARC/"[: len(text[:5])]:
            return None
        end = text.find(b"\r\n\r\n", seen)
        if end >= 0:
            lines = text[:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None
    if text.startswith(b"WARC/"):
        raise ValueError(f"the header of the record at {offset} has no end")
    return None


def record_at(window: _Window, offset: int, skip: int, length: int) -> tuple[bytes, int]:
    """(content, offset behind the member) of the record whose member starts here."""
    z, parts, got, at = zlib.decompressobj(31), [], 0, offset
    while not z.eof:
        piece = window.get(at, READ)
        if not piece:
            raise ValueError(f"a record at {offset} ends in its middle")
        at += len(piece)
        parts.append(z.decompress(piece))
        got += len(parts[-1])
    text = b"".join(parts)
    if len(text) < skip + length:
        raise ValueError(f"the record at {offset} is shorter than its header says")
    return text[skip : skip + length], at - len(z.unused_data)


def records_in(window: _Window, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """Records that start in [start, end): offset, header fields, content."""
    at = start
    while at < end:
        piece = window.get(at, min(READ, end - at) + 2)
        found = piece.find(MAGIC)
        if found < 0 or at + found >= end:
            if at + len(piece) >= min(end, window.size):
                return
            at += max(1, len(piece) - 2)
            continue
        at += found
        head = header_at(window, at)
        if head is None:
            at += 1
            continue
        content, behind = record_at(window, at, head[1], int(head[0]["content-length"]))
        yield at, head[0], content
        at = behind


def read_warc(manifest: DataFrame, *, split: int = SPLIT) -> DataFrame:
    """The records of the files in (file, bytes); the manifest can be a listing of any gzip-compressed archives.

    A response's payload is its content; that of a revisit is null and its length that of the header. Digests of
    responses are checked. Where the manifest has a column records, the records are counted first, and a file with
    another number raises. An empty manifest gives an empty result.
    """
    need(manifest, "file", "bytes")
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("start")).filter("bytes > 0")
    ranges = ranges.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, starts = (c.to_pylist() for c in batch.columns)
            found = []
            for name, size, start in zip(names, sizes, starts, strict=True):
                fs, p = local_or_uri(name)
                with fs.open_input_file(p) as file:
                    found.append(sum(1 for _ in records_in(_Window(file, int(size)), int(start), min(int(start) + split, int(size)))))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], names=["file", "found"])

    if "records" in manifest.columns:
        found = ranges.mapInArrow(count, "file string, found bigint").groupBy("file").agg(F.sum("found").alias("found"))
        stated = manifest.groupBy("file").agg(F.sum("records").alias("records"))
        wrong = stated.join(found, "file", "left").filter(F.coalesce("found", F.lit(0)) != F.col("records")).first()
        if wrong:
            raise ValueError(f"{wrong['file']}: {wrong['found'] or 0} records were found and {wrong['records']} written")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in FIELDS.split(", ")])
        rows, held = [], 0
        frame = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, p = local_or_uri(name)
                with fs.open_input_file(p) as file:
                    for offset, h, content in records_in(_Window(file, int(size)), int(start), min(int(start) + split, int(size))):
                        kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        revisit = kind == "revisit"
                        if not revisit and digest and base32_of(hashlib.sha1(content).hexdigest()) != digest:
                            raise ValueError(f"{name}: the payload at {offset} differs from its digest")
                        length = int(h["x-payload-length"]) if "x-payload-length" in h else None if revisit else len(content)
                        rows.append((name, offset, _page(h.get("warc-record-id")) if "urn:sparkloom:page:" in h.get("warc-record-id", "") else None, kind, h.get("warc-target-uri"), digest, length, _page(h.get("warc-refers-to")) if revisit else None, None if revisit else content))
                        held += len(content)
                        if held >= OUT_BYTES or len(rows) >= 5000:
                            yield frame()
                            rows, held = [], 0
        yield frame()

    return ranges.mapInArrow(read, FIELDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the pages as archives, then reads them by byte ranges."""
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {k}) & 31), 1)" for k in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(h, (1 + 5 * i)::INT, 5))::INT), lambda v: {_DIGIT}), '') AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to, url FROM q
"""
