"""WARC archives: a writer with one gzip member per record and a sequential reader.

Records are made and compressed in tasks and written through Spark's own text writer, so
archives land on whatever file system the folder is on. That writer ends each row with a
separator; a gzip member ends with the top byte of its content's length, which is zero
below 16 MB, so rows leave that byte off and the separator is a zero byte. (A longer record
is followed by an empty member, which ends in zeros too.) The files are plain ``.warc.gz``.

A task closes an archive at a number of compressed bytes or of records, whichever comes first.

The reader walks a file member by member, decompresses in small steps, frames each record by
its content length, and verifies the digests that the record states (SHA-256 or SHA-1, hex or
base 32). Files on a mounted file system (``file:``) are opened as streams, so neither their
size nor a record's bounds a task's memory; elsewhere Spark hands them over whole, at most
2 GB each. Records of other writers are read too: their ``page_id`` is null and ``record_id``
names them, a payload digest that they lack is computed, ``verified`` is null when they state
no digest that can be checked, and records without an HTTP block are payload throughout.

Defined results: a null text is an empty payload; a null url is an empty target; a null id
is kept (its record is a response unless an equal payload has an id); equal payloads under
``least`` bytes are all responses; repeated rows of the smallest id are all responses; empty
tables give no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.llm.common import bare_id, map_batches, null_id, stored

STEP = 1 << 16
RECORD = "page_id bigint, no_page_id boolean, target string, record_type string, refers_to bigint, no_refers_to boolean, payload_bytes bigint, payload_digest string, record_id string, verified boolean"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose last byte is zero."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.flush()
    return out + (member(b"") if out[-1] else b"")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A WARC/1.1 response, or the revisit of one, with block and payload digests."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
            ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html",
                   records_per_file: int = 4_000, bytes_per_file: int = 64 << 20) -> None:
    """One record per row under ``path``. Of equal payloads of ``least`` bytes or more the
    smallest id is the response and the others revisit it. An archive takes records up to
    ``bytes_per_file`` compressed bytes (more only if one record has more) and ``records_per_file``."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"),
                        F.sha2(body, 256).alias("digest"))
    # only payloads that occur again; their list is small unless most pages are copies
    again = (rows.where(F.octet_length("body") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    rows = rows.join(stored(again, "repeated-payloads"), "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = size = count = 0
        for batch in batches:
            out = []
            for p, no_p, u, b, r, no_r, d in batch.itertuples(index=False):
                squeezed = member(record(None if no_p else p, u, b.encode("utf-8"), None if no_r else r, d))[:-1]
                if count == records_per_file or count and size + len(squeezed) >= bytes_per_file:
                    archive, size, count = archive + 1, 0, 0
                size, count = size + len(squeezed) + 1, count + 1
                out.append((squeezed, archive))
            yield pd.DataFrame(out, columns=["member", "archive"])

    rows = bare_id(bare_id(rows, "page_id"), "refers_to")
    columns = ["page_id", "no_page_id", "url", "body", "refers_to", "no_refers_to", "digest"]
    members = map_batches(rows.select(*columns), run, "member binary, archive int")
    # a folder for each number, in which each task has a file of its own
    (members.select(F.col("member").cast("string").alias("value"), "archive").write.option("lineSep", "\0").partitionBy("archive").text(path))


class _Member:
    """Bytes of consecutive gzip members, read and decompressed ``STEP`` at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.ahead, self.left = source, b"", b""
        self.inflate = None

    def read(self) -> bytes:
        part, self.ahead = self.ahead or self.source.read(STEP), b""
        return part

    def more(self) -> bool:
        """Next part of this member into ``left``; false at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        tail = self.inflate.unconsumed_tail
        part = tail or self.read()
        out = self.inflate.decompress(part, STEP)
        if not part and not out and not self.inflate.eof:
            raise ValueError("truncated gzip member")
        self.left += out
        if self.inflate.eof:
            self.ahead = self.inflate.unused_data + self.ahead
        return True

    def open(self) -> bool:
        """Start at the next member; false at the end of the file."""
        while self.more():
            pass
        if self.left.strip(b"\r\n"):
            raise ValueError("a member goes on after its record")
        self.left = b""
        self.ahead = self.read()
        if not self.ahead:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.left:
            if not self.more():
                return b""
        head, _, self.left = self.left.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in parts."""
        while n:
            if not self.left and not self.more():
                raise ValueError("record is shorter than its content length")
            part, self.left = self.left[:n], self.left[n:]
            n -= len(part)
            if part:
                yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _agrees(stated: str | None, sums: dict) -> bool | None:
    """Whether a stated digest (``algorithm:value``) is the one computed; null if it cannot be told."""
    name, _, value = (stated or "").partition(":")
    have = sums.get(name.lower().replace("-", ""))
    if have is None or not value:
        return None
    return value.lower() == have.hexdigest() or value.upper().rstrip("=") == base64.b32encode(have.digest()).decode().rstrip("=")


def _page(name: str | None) -> int | None:
    """The id in a record name of ``write_archives``."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    return int(found[1]) if found else None


def read_records(content: bytes | BinaryIO, keep_payload: bool = False) -> Iterator[tuple]:
    """The records of one archive in order: the fields of ``RECORD`` (and the payload)."""
    stream = _Member(io.BytesIO(content) if isinstance(content, bytes) else content)
    while stream.open():
        head = stream.until(b"\r\n\r\n")
        if not head:
            if stream.left:
                raise ValueError("not a WARC record")
            continue  # an empty member
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block, payload = ({n: hashlib.new(n) for n in ("sha256", "sha1")} for _ in range(2))
        inside = "application/http" not in fields.get("content-type", "").lower()
        http, kept, size = b"", [], 0
        for part in stream.take(int(fields["content-length"])):
            for x in block.values():
                x.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                inside = True
            for x in payload.values():
                x.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("record does not end where its content length says")
        kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest")
        checks = [_agrees(fields.get("warc-block-digest"), block)]
        length = size
        if kind == "revisit":  # the payload is elsewhere
            told = _fields(http).get("content-length", "")
            length = int(told) if told.isdecimal() else size
        else:
            checks.append(_agrees(stated, payload))
        checks = [x for x in checks if x is not None]
        digest = stated.partition(":")[2] if stated else payload["sha256"].hexdigest()
        page, refers = _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to"))
        row = (page or 0, page is None, fields.get("warc-target-uri"), kind, refers or 0, refers is None, length, digest,
               fields.get("warc-record-id"), all(checks) if checks else None)
        yield (*row, None if kind == "revisit" else b"".join(kept)) if keep_payload else row


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Rows of ``RECORD`` (and ``payload``) of all archives under ``path``; a file is read by one task."""
    schema = RECORD + ", payload binary" * keep_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in batch.itertuples(index=False):
                rows, held = [], 0
                with open(re.sub(r"^file:(//)?", "", place), "rb") if content is None else io.BytesIO(content) as source:
                    for row in read_records(source, keep_payload):
                        rows.append(row)
                        held += len(row[-1] or b"") if keep_payload else 0
                        if len(rows) == 500 or held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mounted = F.col("path").startswith("file:")
    files = files.select("path", "content") if _elsewhere(files, mounted) else files.select("path", F.lit(None).cast("binary").alias("content"))
    return null_id(null_id(map_batches(files, run, schema), "page_id"), "refers_to")


def _elsewhere(files: DataFrame, mounted: Column) -> bool:
    """Whether a file is on a file system that a task cannot open by itself."""
    return not files.select("path").where(~mounted).isEmpty()
