import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media as M

DOCS = "doc_id long, text string, media string, n_bytes string"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_images_are_lossless(text):
    payload = M.payload_of(text)
    assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0") and len(payload) > 0
    image = M.encode_png(payload)
    assert M.decode_png(image).tobytes() == payload
    spoiled = bytearray(image)
    spoiled[len(image) // 2] ^= 1
    with pytest.raises(Exception):
        M.decode_png(bytes(spoiled))


def test_round_trip(spark, tmp_path):
    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 64), (6, "y" * 300_000), (None, "no id"), (1, "text")]
    docs = spark.createDataFrame([(i, t, "clash", "c") for i, t in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.n_bytes): r for r in M.media_columns(docs).collect()}
    assert len(M.media_columns(docs).collect()) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        r = got[(i, len(raw))]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        image = M.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == M.feature_of(np.frombuffer(payload, np.uint8).reshape(-1, 64))
    assert M.media_columns(docs.limit(0)).collect() == []


def test_ranges_split_archives_without_loss(spark, tmp_path):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat(cast(id as string), cast(id as int)) as text")
    manifest = M.write_archives(docs.coalesce(2), f"file://{tmp_path}/store")
    for size in (700, 4096, 1 << 30):
        df = M.read_archives(spark, manifest, size)
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == list(range(500))
    # a file that no committed row lists is not read
    Path(tmp_path, "store", "left-over.media").write_bytes(b"half an archive")
    assert M.read_archives(spark, manifest).count() == 500


def test_members_are_read_again_by_offset(spark, tmp_path, monkeypatch):
    manifest = M.write_archives(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/store")
    listed = pq.read_table(manifest.removeprefix("file://"))
    part = M.planned(listed)[0]
    opened, real = [], pa.fs.FileSystem.from_uri

    class Flaky:
        def __init__(self, f, spoil):
            self.f, self.spoil = f, spoil

        def read(self, n):
            data = self.f.read(n)
            if self.spoil and n != 24 and data[:4] == b"\x89PNG" and len(opened) < 3:
                return b"?" * len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    class Store:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            opened.append(path)
            return Flaky(self.fs.open_input_file(path), True)

    monkeypatch.setattr(M.pa.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: (Store(real(uri)[0]), real(uri)[1]))}))
    got = pa.Table.from_batches(list(M.read_range(part)))
    assert got.num_rows == 20 and len(opened) >= 3


def test_lasting_damage_is_an_error(spark, tmp_path):
    manifest = M.write_archives(spark.createDataFrame([(1, "text")], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/store")
    listed = pq.read_table(manifest.removeprefix("file://"))
    path = Path(listed.column("path")[0].as_py().removeprefix("file://"))
    data = bytearray(path.read_bytes())
    data[50] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="checksum"):
        list(M.read_range(M.planned(listed)[0]))


def test_ranges_follow_bytes_and_cores(spark, tmp_path, monkeypatch):
    assert [M.range_size(n, 24) for n in (0, 100 << 20, 24 << 27, 100 << 40)] == [8 << 20, 8 << 20, 1 << 27, 1 << 30]
    monkeypatch.setattr(M, "MEMBERS_MOST", 7)  # archives are closed at so many members, however small
    folder = tmp_path / "store"
    text = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    writer = M.ArchiveWriter(pa.fs.LocalFileSystem(), str(tmp_path / "one"))
    for i in range(3):
        writer.add(i, 1, b"x")
    writer.close()
    with open(tmp_path / "one", "rb") as f:
        assert M.read_directory(f, (tmp_path / "one").stat().st_size).num_rows == 3
    manifest = M.write_archives(text, f"file://{folder}")
    assert sorted(r.doc_id for r in M.read_archives(spark, manifest).collect()) == list(range(20))
