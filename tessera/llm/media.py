"""Media columns: payloads as lossless images in archives, read by a custom data source.

A payload becomes a grey PNG image of 8-bit samples, 64 to a row. Tasks write images as members of archive files; each
archive ends with a directory of its members. The data source plans byte ranges over the archives that a committed table
lists, so that files of failed or doubled tasks don't count; a range's reader takes the members that begin in it,
streams them through Arrow in bounded batches, and reads a member that fails its checksum again by its own offset.

Defined results: null and empty texts are one row of 64 zero bytes. Rows are stored one by one, repeated rows too; null
ids stay null. Equal texts give equal media and features. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import batch, new_path, text_pass

WIDTH = 64
#: Bytes and members of an archive file; least and most bytes of a planned range; bytes of a batch.
FILE, MEMBERS_MOST, RANGES, BATCH = 1 << 30, 1 << 18, (8 << 20, 1 << 30), 4 << 20
TRIES = 3
MAGIC = b"TESSERA1"
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None, width: int = WIDTH) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of the width."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % width if data else width)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit image, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    return PNG + _part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), level)) + _part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples (rows x width) of an image that encode_png wrote; any damage raises ValueError."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, size, packed = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a part of the image is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a plain grey image of 8-bit samples")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, spread and a 64-bit average hash (8 bands of rows by 8 of columns)."""
    h, w = samples.shape
    bands = np.array_split(samples.mean(axis=0, dtype=np.float64), 8)
    columns = np.array([b.mean() for b in bands])
    edges = np.minimum(np.arange(8) * h // 8, h - 1)
    rows = np.add.reduceat(samples.sum(axis=1, dtype=np.int64), edges) if h >= 8 else samples.sum(axis=1, dtype=np.int64)[edges]
    counts = np.diff(np.append(edges, h)) if h >= 8 else np.ones(8)
    cells = (rows / counts / w)[:, None] + columns[None, :]
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{w}x{h} mean={samples.mean(dtype=np.float64):.4f} spread={samples.std(dtype=np.float64):.4f} hash={bits}"


DIRECTORY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
ARCHIVES = pa.schema([("path", pa.string()), ("members_bytes", pa.int64()), ("members", pa.int64())])


class ArchiveWriter:
    """An archive file: members one after another, their directory as an Arrow stream, its place, and a mark."""

    def __init__(self, fs, path: str):
        self.out, self.at = fs.open_output_stream(path, compression=None), 0
        self.rows: dict[str, list] = {n: [] for n in DIRECTORY.names}

    def add(self, doc_id: int | None, n_bytes: int, data: bytes) -> None:
        for k, v in zip(DIRECTORY.names, (doc_id, n_bytes, self.at, len(data), zlib.crc32(data))):
            self.rows[k].append(v)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DIRECTORY) as w:
            w.write_batch(batch(DIRECTORY, **self.rows))
        listed = zlib.compress(sink.getvalue().to_pybytes(), 1)
        self.out.write(listed + struct.pack("<QQ", self.at, len(listed)) + MAGIC)
        self.out.close()


def read_directory(file, size: int) -> pa.Table:
    file.seek(size - 24)
    tail = file.read(24)
    if tail[16:] != MAGIC:
        raise ValueError("not an archive, or cut short")
    at, n = struct.unpack("<QQ", tail[:16])
    file.seek(at)
    return pa.ipc.open_stream(zlib.decompress(file.read(n))).read_all()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def range_size(total: int, tasks: int) -> int:
    """Bytes of a range: some for each of ``tasks``, between the bounds of RANGES, so that the driver plans few of them."""
    return min(max(total // max(1, tasks), RANGES[0]), RANGES[1])


def planned(listed: pa.Table, size: int = RANGES[0]) -> list[Range]:
    """Byte ranges over the archives of a manifest; together they hold each member's first byte once."""
    out = []
    for path, n in zip(listed.column("path").to_pylist(), listed.column("members_bytes").to_pylist()):
        out += [Range(path, at, min(at + size, n)) for at in range(0, n, size)]
    return out


def read_member(path: str, offset: int, length: int, crc: int, tries: int = TRIES) -> bytes:
    """One member by its own offset, from a fresh open of the file each time."""
    for attempt in range(tries):
        try:
            fs, at = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                f.seek(offset)
                data = f.read(length)
            if zlib.crc32(data) == crc:
                return data
        except OSError:
            if attempt == tries - 1:
                raise
    raise ValueError(f"{path}: the member at {offset} fails its checksum after {tries} reads")


MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The members that begin in the range, in batches of bounded bytes."""
    fs, at = pa.fs.FileSystem.from_uri(part.path)
    with fs.open_input_file(at) as f:
        listed = read_directory(f, f.size())
        offsets = listed.column("offset").to_numpy()
        first, last = np.searchsorted(offsets, [part.start, part.end])
        rows = listed.slice(int(first), int(last - first)).to_pylist()
        held: list[tuple] = []
        size = 0
        for r in rows:
            try:
                f.seek(r["offset"])
                data = f.read(r["length"])
            except OSError:
                data = b""
            if zlib.crc32(data) != r["crc32"]:
                data = read_member(part.path, r["offset"], r["length"], r["crc32"])
            held.append((r["doc_id"], r["n_bytes"], data))
            size += len(data)
            if size >= BATCH:
                yield batch(MEMBERS, **dict(zip(MEMBERS.names, map(list, zip(*held)))))
                held, size = [], 0
        if held:
            yield batch(MEMBERS, **dict(zip(MEMBERS.names, map(list, zip(*held)))))


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        fs, at = pa.fs.FileSystem.from_uri(self.options["manifest"])
        listed = pa.parquet.read_table(at, filesystem=fs, schema=ARCHIVES)
        total = sum(listed.column("members_bytes").to_pylist())
        size = int(self.options.get("range_bytes", 0)) or range_size(total, int(self.options.get("tasks", 64)))
        return planned(listed, size) or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_range(partition)


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("manifest", folder): doc_id, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


def write_archives(docs: DataFrame, folder: str) -> str:
    """Stores each row's payload; returns the folder of the manifest, which Spark commits last."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, done = None, "", []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", out.at, len(out.rows["offset"])))
                out = None

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.media"
                    out = ArchiveWriter(fs, f"{base}/{name}")
                text = text.as_py()
                payload = payload_of(text)
                out.add(doc_id, len(text.encode("utf-8", "surrogatepass")) if text else 0, encode_png(payload))
                if out.at >= FILE or len(out.rows["offset"]) >= MEMBERS_MOST:
                    close()
        close()
        yield batch(ARCHIVES, **(dict(zip(ARCHIVES.names, map(list, zip(*done)))) if done else {n: [] for n in ARCHIVES.names}))

    manifest = f"{folder}/manifest"
    text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, "path string, members_bytes long, members long").write.parquet(manifest)
    return manifest


def read_archives(spark: SparkSession, manifest: str, range_bytes: int = 0) -> DataFrame:
    """The members of all archives of a manifest; without range_bytes, ranges are sized by the archives and the cores."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("manifest", manifest).option("range_bytes", str(range_bytes)).option("tasks", str(4 * spark.sparkContext.defaultParallelism)).load()


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes say: payload and media lengths and digests, and a feature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {n: [] for n in OUT.names}
            for doc_id, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = data.as_py()
                samples = decode_png(data)
                payload = samples.tobytes()
                row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples))
                for k, v in zip(OUT.names, row):
                    out[k].append(v)
            yield batch(OUT, **out)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores all rows of docs as media and describes them as read back."""
    spark = docs.sparkSession
    return described(read_archives(spark, write_archives(docs, folder or new_path(spark, "media"))))
