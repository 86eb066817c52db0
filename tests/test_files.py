"""Containers, listings, run logs and letterheads on hand-made input."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import containers as C
from tessera.sources import letterhead, tables

BODY = """<w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:p/><w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t> wide </w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>last</w:t></w:r></w:p>"""


def docx(body, member=C.MEMBER):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, f'<w:document xmlns:w="{C.NAMESPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_paragraphs_and_cells():
    status, text, paragraphs, rows = C.text_of(docx(BODY))
    assert (status, paragraphs, rows) == ("read", 4, 4)
    assert text == "One\ttwo\nthree\nlink\nlast\nwide | wide | \na\nb | c\na\nb | d"


def test_files_that_cannot_be_read():
    whole = docx(BODY)
    kinds = {whole[:80]: "damaged", whole[: len(whole) // 2]: "damaged", docx(BODY, "other.xml"): "damaged", docx("<w:p>"): "damaged", b"PK\x03\x04": "damaged", b"": "unrecognised", b"%PDF-1": "pdf", b"text": "unrecognised"}
    assert {k: C.text_of(k)[0] for k in kinds} == kinds
    spoiled = bytearray(whole)
    spoiled[60:90] = bytes(30)
    assert C.text_of(bytes(spoiled))[0] == "damaged"
    assert C.text_of(docx("<w:p><w:r><w:t>x</w:t></w:r></w:p>" * 9000), most=100_000)[:2] == ("too large", None)


def test_round_trip_through_files(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    rows = [("a.docx", ["x & <y>", "", "tab\there", "cr\r\nlf"], [["1", " 2 "], ["", ""]]), ("b.docx", [], []), ("sub-c.docx", ["\x00\x0bq\U0001f600"], None)]
    made = C.contents(spark.createDataFrame(rows, "n string, p array<string>, r array<array<string>>"), "n", "p", "r")
    assert C.write_files(made, folder) == 3
    assert C.write_files(made.withColumn("content", F.lit(b"nothing")).limit(1).withColumn("name", F.lit("d.txt")), folder) == 1
    got = {r.name: (r.status, r.text) for r in C.documents(spark, folder).collect()}
    assert got == {"a.docx": ("read", "x & <y>\ntab\there\ncr\r\nlf\n1 | 2"), "b.docx": ("read", ""), "sub-c.docx": ("read", "q\U0001f600"), "d.txt": ("unrecognised", None)}
    assert {r.name: r.status for r in C.documents(spark, folder, most=10).collect()} == {"a.docx": "too large", "b.docx": "too large", "sub-c.docx": "too large", "d.txt": "unrecognised"}
    found = C.listed(spark, folder, "*.docx")
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.docx", "b.docx", "sub-c.docx"} and all(r.length > 100 for r in found.collect())
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().replace("contentlength", "")


def test_run_log_of_any_shape(spark, tmp_path):
    values = [True, False, None, 0, 2, -0.5, "", "no", [], [0], {}, {"a": None}]
    lines = [json.dumps({"started": str(i), "apply": v, "results": [{"stage": "s", "changed": v}, i, None, "x", [1], {"changed": {"deep": [v]}}]}) for i, v in enumerate(values)]
    lines += ["{broken", "", "7", "null", "[]", '{"results": {"stage": "a"}}', '{"results": null}', "{}", '{"started": 5, "results": [{"stage": 3}]}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = sorted((r.started, r.place, r.apply, r.stage, r.changed) for r in tables.run_log(spark, str(tmp_path)).collect())
    want = [(str(i), 0, bool(v), "s", bool(v)) for i, v in enumerate(values)] + [(str(i), 5, bool(v), None, True) for i, v in enumerate(values)] + [("5", 0, False, "3", False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_cut(tops, height, rects, width):
    for x0, x1, top, bottom, filled in rects:
        if filled and top <= 2 and x1 - x0 >= width * 0.8 and 8 < bottom <= height * 0.3:
            return bottom
    tops = sorted({round(t, 1) for t in tops if round(t, 1) <= height * 0.3})
    gaps = sorted((b - a, a) for a, b in zip(tops, tops[1:]))
    if not gaps or gaps[len(gaps) // 2][0] <= 0 or gaps[-1][0] < gaps[len(gaps) // 2][0] * 1.6:
        return 0.0
    return gaps[-1][1] + gaps[-1][0] / 2


def test_bands(spark):
    rng = random.Random(1)
    pages, words, rects, want = [], [], [], {}
    for d in range(60):
        tops = [x / 2 for x in rng.sample(range(20, 900), rng.randrange(9))] if d % 2 else [20 + 12 * i + (60 if i > d % 9 else 0) for i in range(20)]
        own = [(rng.choice([0.0, 100.0]), 590.0, rng.choice([0.0, 5.0]), rng.choice([7.0, 40.0, 400.0]), rng.random() < 0.6) for _ in range(rng.randrange(3))]
        pages.append((d, 595.0, 842.0))
        words += [(d, float(t)) for t in tops] * 2
        rects += [(d, i, *r) for i, r in enumerate(own)]
        want[d] = plain_cut(tops, 842.0, own, 595.0)
    got = letterhead.band(spark.createDataFrame(words, "doc long, top double"), spark.createDataFrame(pages, "doc long, width double, height double"), spark.createDataFrame(rects, "doc long, place int, x0 double, x1 double, top double, bottom double, filled boolean"))
    assert {r.doc: pytest.approx(r.cut) for r in got.collect()} == want and len({v for v in want.values()}) > 10


@pytest.mark.parametrize(("text", "strip", "left"), [
    ("Head\n\n second  line \nbody\nHead", ["head", "Second line"], "body\nHead"),
    ("body\nHead", ["Head"], "body\nHead"),
    ("\n\nHead\nother\nx", ["Head", "next"], "other\nx"),
    ("\n\nbody", ["Head"], "body"),
    ("Head", ["Head"], ""),
    ("Head\nx", [], "Head\nx"),
    ("Head\nx", None, "Head\nx"),
])
def test_stripped(spark, text, strip, left):
    df = spark.createDataFrame([(text, strip)], "t string, s array<string>")
    assert df.select(letterhead.stripped(F.col("t"), F.col("s"))).first()[0] == left
