"""WARC archives as a chunked record table, written and read chunk by chunk.

Payloads travel as rows of a record's identifier and a chunk number. On writing, a record's chunks go one after another
into its gzip member, and the digest carried along must be the one in its header when the last has passed. On reading,
each row has the digest and length of the payload so far, so that the last row of a record carries the digest of the
whole. No Python worker and no Arrow batch holds a whole record; the JVM does, once, as html is one cell of its table.
Records of equal payloads are written once; the others are revisits that refer to it. Archives hold a gzip member for
each record; tasks write them to the shared folder, and a table of block ranges, committed by Spark, says what counts, so that
files of failed or doubled tasks are never read.

Defined results: null html is an empty payload. Payloads under ``least`` bytes are never revisits. Of records with equal
payloads the one with the largest page_id is the response (null ranks lowest; of rows with the same page_id, one). An
empty table gives empty archives and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, maybe_broadcast, new_path, numbered, skew_join, text_pass, written

#: Bytes of a chunk; compressed bytes of a block, and of an archive file; most bytes of the blocks that one task reads.
CHUNK, BLOCK, FILE, TASK = 1 << 18, 8 << 20, 256 << 20, 256 << 20
KEY = ["payload_sha256", "payload_bytes"]


def base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), and its length and digests; all in the JVM."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_sha256": F.sha2("html", 256), "payload_sha1": F.sha1("html")})


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """The rows of digests() with ``refers_to_id`` and ``revisit``. Payloads are shuffled only if the revisits are many."""
    rows = digests(pages)
    keys = written(rows.select("page_id", *KEY), "warc-keys")
    total = keys.count()
    once = keys.groupBy("page_id", *KEY).agg(F.count(F.lit(1)).alias("m"))
    groups = once.groupBy(*KEY).agg(F.sum("m").alias("n"), F.max("page_id").alias("response_id")).filter((F.col("n") > 1) & (F.col("payload_bytes") >= least))
    groups = written(groups, "warc-groups")
    found = written(skew_join(once, groups, KEY, "n", total, F.col("page_id"), "inner"), "warc-revisits")
    n = found.count()
    back = maybe_broadcast(found.select(F.coalesce("page_id", F.lit(-1)).alias("_id"), F.col("page_id").isNull().alias("_null"), *KEY, "response_id", "m"), n, 120)
    repeated = not found.filter(first_of(found) & (F.col("m") > 1)).isEmpty()
    row = "_row"
    if repeated:  # rows that share page_id and payload: one of them is the response
        rows, row = numbered(rows, "warc-numbered")
    out = rows.withColumns({"_id": F.coalesce("page_id", F.lit(-1)), "_null": F.col("page_id").isNull()}).join(back, ["_id", "_null", *KEY], "left")
    first = F.col("page_id").eqNullSafe(F.col("response_id"))
    if repeated:
        ones = out.filter(first & (F.col("m") > 1)).groupBy("_id", "_null", *KEY).agg(F.min(row).alias(row))
        ones = written(ones.select(row, F.lit(True).alias("_one")), "warc-ones")
        out = out.join(maybe_broadcast(ones, ones.count(), 16), row, "left")
        first = first & ((F.col("m") == 1) | F.coalesce("_one", F.lit(False)))
    revisit = F.col("m").isNotNull() & ~first
    return out.select("page_id", "url", "html", *KEY, "payload_sha1", revisit.alias("revisit"), F.when(revisit, F.col("response_id")).alias("refers_to_id"))


def first_of(found: DataFrame):
    return found["page_id"].eqNullSafe(found["response_id"])


def chunk_rows(planned_rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """page_id, url, payload_bytes, payload_sha1, revisit, refers_to_id, chunk_no, last, chunk: a row for each ``size`` bytes of
    each payload, in order within a task; one empty chunk for revisits and empty payloads."""
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("html").cast("binary"))
    n = lambda b: F.greatest(F.lit(1), F.ceil(F.octet_length(b) / size)).cast("int")
    cut = lambda b: F.transform(F.sequence(F.lit(0), n(b) - 1), lambda i: F.struct((i == n(b) - 1).alias("last"), F.substring(b, i * size + 1, F.lit(size)).alias("chunk")))
    pieces = F.get(F.transform(F.array(body), cut), 0)  # the payload's bytes are made once
    rows = planned_rows.select("page_id", "url", "payload_bytes", "payload_sha1", "revisit", "refers_to_id", F.posexplode(pieces).alias("chunk_no", "x"))
    return rows.select("page_id", "url", "payload_bytes", "payload_sha1", "revisit", "refers_to_id", "chunk_no", "x.last", "x.chunk")


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _id(uri: str) -> int | None:
    value = uri.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def record_head(page_id: int | None, url: str | None, n: int, sha1: str, revisit: bool, refers_to: int | None) -> bytes:
    """WARC and HTTP headers of a record; the payload, if any, follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    kind = "WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" + f"WARC-Refers-To: {_uri(refers_to)}\r\n" if revisit else "WARC-Type: response\r\n"
    target = urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]", errors="replace")
    head = f"WARC/1.1\r\n{kind}WARC-Record-ID: {_uri(page_id)}\r\nWARC-Target-URI: {target}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + (0 if revisit else n)}\r\n\r\n"
    return (head + http).encode()


BLOCKS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])


def write_archives(planned_rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes archives to a folder of the shared store; the committed table of blocks (path, start, length, records)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, at, done, start, records, z, digest = None, "", 0, [], 0, 0, None, None

        def close() -> None:
            nonlocal out, start, records
            if out is not None:
                if records:
                    done.append((path, start, at - start, records))
                out.close()
                out, start, records = None, 0, 0

        def put(part: bytes | memoryview) -> None:
            nonlocal at
            got = z.compress(part)
            at += len(got)
            out.write(got)

        for b in it:
            for page, url, n, sha1, revisit, refers, number, last, chunk in zip(*[c.to_pylist() for c in b.columns[:-1]], b.column(b.num_columns - 1)):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
                if number == 0:
                    z, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    put(record_head(page, url, n, base32(sha1), revisit, refers))
                data = memoryview(chunk.as_buffer())
                digest.update(data)
                put(data)
                if not last:
                    continue
                if not revisit and digest.hexdigest() != sha1:
                    raise ValueError(f"page {page}: the chunks' digest is {digest.hexdigest()}, not {sha1}")
                put(b"\r\n\r\n")
                got = z.flush()
                at += len(got)
                out.write(got)
                records += 1
                if at - start >= BLOCK:
                    done.append((path, start, at - start, records))
                    start, records = at, 0
                if at >= FILE:
                    close()
        close()
        yield batch(BLOCKS, **dict(zip(BLOCKS.names, map(list, zip(*done)))) if done else {n: [] for n in BLOCKS.names})

    rows = text_pass(chunk_rows(planned_rows), ["*"], run, "path string, start long, length long, records long")
    return written(rows, "warc-blocks")


class _Stream:
    """Members of a block, decompressed piece by piece."""

    def __init__(self, file, length: int):
        self.file, self.left, self.raw, self.z, self.held = file, length, b"", None, b""

    def next_member(self) -> bool:
        if not self.raw and self.left:
            self._load()
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _load(self) -> None:
        self.raw = self.file.read(min(CHUNK, self.left))
        if not self.raw:
            raise EOFError("an archive ends before its block does")
        self.left -= len(self.raw)

    def some(self) -> bytes:
        """Up to CHUNK more bytes of the member; empty at its end."""
        while not self.held and not self.z.eof:
            self.held = self.z.decompress(self.raw, CHUNK)  # without input, it gives what it still holds
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if not self.held and not self.z.eof and not self.raw:
                self._load()
        got, self.held = self.held, b""
        return got

    def until(self, mark: bytes) -> bytes:
        got = b""
        while mark not in got:
            more = self.some()
            if not more:
                raise ValueError("a record ends in its header")
            got += more
        head, _, self.held = got.partition(mark)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            more = self.some()
            if not more:
                raise ValueError("a record is shorter than its header says")
            part, self.held = more[:n], more[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string())])


def record_chunks(stream: _Stream) -> Iterator[tuple]:
    """Rows of the chunk table for each record of a block; a revisit is one row with what its headers say."""
    while stream.next_member():
        warc = _fields(stream.until(b"\r\n\r\n"))
        page, kind = _id(warc["warc-record-id"]), warc["warc-type"]
        said = warc["warc-payload-digest"].removeprefix("sha1:")
        http = stream.until(b"\r\n\r\n")
        n = int(_fields(http)["content-length"])
        if kind == "revisit":
            yield page, kind, _id(warc["warc-refers-to"]), 0, True, b"", n, said
        else:
            sha1, so_far, number = hashlib.sha1(), 0, 0
            for part in stream.exactly(n) if n else (b"",):
                sha1.update(part)
                so_far += len(part)
                digest = base64.b32encode(sha1.digest()).decode()
                if so_far == n and digest != said:
                    raise ValueError(f"page {page}: the payload's digest is {digest}, not {said}")
                yield page, kind, None, number, so_far == n, part, so_far, digest
                number += 1
        if b"".join(iter(stream.some, b"")) != b"\r\n\r\n":
            raise ValueError(f"page {page}: the record does not end where its header says")


def read_archives(blocks: DataFrame, tries: int = 3) -> DataFrame:
    """The chunk table of all records. A block is the unit of work; a failed read of it starts over in the task."""

    def rows_of(path: str, start: int, length: int) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            f.seek(start)
            held, size = [], 0
            for row in record_chunks(_Stream(f, length)):
                held.append(row)
                size += len(row[5]) + 100
                if size >= 8 * CHUNK:
                    yield batch(CHUNKS, **dict(zip(CHUNKS.names, map(list, zip(*held)))))
                    held, size = [], 0
            if held:
                yield batch(CHUNKS, **dict(zip(CHUNKS.names, map(list, zip(*held)))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, start, length in zip(*[c.to_pylist() for c in b.columns]):
                sent = 0
                for attempt in range(tries):
                    try:
                        for k, got in enumerate(rows_of(path, start, length)):
                            if k >= sent:  # what an attempt before this one has sent is not sent again
                                sent += 1
                                yield got
                        break
                    except OSError:
                        if attempt == tries - 1:
                            raise

    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(n, max(4 * cores, -(-total // TASK))))  # blocks of TASK bytes at most to a task, but some tasks for each core
    schema = "page_id long, record_type string, refers_to long, chunk_no long, last boolean, chunk binary, bytes_so_far long, sha1_so_far string"
    return blocks.select("path", "start", "length").repartition(n).mapInArrow(run, schema)


def archived(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages to archives and reads them back: the chunk table."""
    folder = folder or new_path(pages.sparkSession, "warc")
    blocks = write_archives(planned(pages, least), folder)
    return read_archives(blocks)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back, one row per row of pages."""
    return archived(pages, least).filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
