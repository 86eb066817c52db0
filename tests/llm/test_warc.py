import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from tessera.llm import warc as W

PAGES = "page_id long, url string, html string, payload_bytes string, m int"


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        known = [i for i in ids if i is not None]
        top, used = max(known) if known else None, False
        for i in ids:
            first = i == top and not used
            used |= first
            revisit = len(ids) > 1 and len(raw) >= least and not first
            out.append((i, len(raw), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], PAGES)


ROWS = [(1, "http://a", "<p>x"), (2, "http://b\r\nX: y", "<p>x"), (3, None, None), (4, "u", ""), (5, "é", "é" * 400_000), (9, "v", "é" * 400_000), (7, "w", "lone"), (None, "n", "lone")]


@pytest.mark.parametrize("least", [0, 4, 5])
def test_against_brute_force(spark, least):
    got = sorted([tuple(r) for r in W.records(table(spark, ROWS), least).collect()], key=str)
    assert got == brute(ROWS, least)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a", "same"), (1, "a", "same"), (1, "b", "same"), (0, "c", "same"), (None, "d", "alone"), (None, "d", "alone")]
    assert sorted([tuple(r) for r in W.records(table(spark, rows)).collect()], key=str) == brute(rows)
    assert W.records(table(spark, [])).collect() == []


def test_chunks_carry_digests_and_lengths(spark, monkeypatch, tmp_path):
    folder = f"file://{tmp_path}/archive"
    rows = [*ROWS, *((100 + i, "u", f"text {i} " * 20_000) for i in range(40))]
    blocks = W.write_archives(W.planned(table(spark, rows)).coalesce(2), folder)
    chunks = W.read_archives(blocks).collect()
    by = defaultdict(list)
    for c in chunks:
        by[c.page_id].append(c)
    for i, _, html in rows:
        own = sorted(by[i], key=lambda c: c.chunk_no)
        assert [c.chunk_no for c in own] == list(range(len(own))) and [c.last for c in own] == [False] * (len(own) - 1) + [True]
        if own[0].record_type == "response":
            done = b""
            for c in own:
                done += bytes(c.chunk)
                assert c.bytes_so_far == len(done) and c.sha1_so_far == base64.b32encode(hashlib.sha1(done).digest()).decode()
            assert done == (html or "").encode()
    assert len(by[100]) >= 1 and max(len(c.chunk) for c in chunks) <= W.CHUNK
    # the archives are plain gzip members of WARC records
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "archive").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: y" not in text
    # files that no committed block lists are not read
    Path(tmp_path, "archive", "left-over.warc.gz").write_bytes(b"half")
    assert W.read_archives(blocks).count() == len(chunks)


def test_blocks_and_damage(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "BLOCK", 1)
    blocks = W.write_archives(W.planned(table(spark, ROWS)).coalesce(1), f"file://{tmp_path}/archive")
    assert blocks.count() >= 1
    path = next(Path(tmp_path, "archive").glob("*.warc.gz"))
    raw = path.read_bytes()
    path.write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception):
        W.read_archives(blocks).collect()


def test_payloads_travel_in_chunks(spark):
    rows = [(1, "http://a/1", "é" * 700), (2, "http://a/2", None), (3, "http://a/3", "x" * 64), (4, "http://a/4", "é" * 700)]
    got = W.chunk_rows(W.planned(table(spark, rows)), size=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert {i: b"".join(bytes(r.chunk) for r in sorted(x, key=lambda r: r.chunk_no)) for i, x in by.items()} == {1: b"", 2: b"", 3: b"x" * 64, 4: ("é" * 700).encode()}
    assert max(len(r.chunk) for r in got) == 64 and [r.last for r in by[4]] == [False] * 21 + [True] and [r.revisit for r in by[1]] == [True]


def test_a_wrong_digest_is_not_written(spark, tmp_path):
    from pyspark.sql import functions as F

    wrong = W.planned(table(spark, [(1, "http://a/1", "text")])).withColumn("payload_sha1", F.lit("0" * 40))
    with pytest.raises(Exception, match="digest"):
        W.write_archives(wrong, f"file://{tmp_path}/archive")


def test_many_rows_of_one_page(spark):
    rows = [(1, f"http://a/{i}", "same") for i in range(300)] + [(0, "http://b", "same")]
    got = [tuple(r) for r in W.records(table(spark, rows)).collect()]
    assert sorted(x[3] for x in got).count("response") == 1 and len(got) == 301 and {x[4] for x in got if x[3] == "revisit"} == {1}
