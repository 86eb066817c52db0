import pytest
from pyspark.sql import functions as F

from tessera.functions import citations, fixed, ids, text, values, verdicts
from tessera.operators import resolve
from tessera.sources import html


def each(spark, f, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, c string").repartition(2)
    return [r[1] for r in sorted(df.select("i", f(F.col("c"))).collect())]


def test_numbers_of_designations(spark):
    cases = {"IS -1": "", "IS ABC": "", "": "", "IS 99999999": "", "IS 1239 Part II": "1239", "IS 432 : Part 1 : 1982": "432", "IS 2403 : 2014 / ISO 606 : 2004": "2403", "IS 8828 *": "8828", "IS:694": "694", "IS/IEC 60947 (Part 1):2020": "60947", "IS 0123": "123", "is 10": "10"}
    assert each(spark, ids.number, cases) == list(cases.values())
    assert each(spark, ids.number, [None]) == [""]


def test_keys(spark):
    assert each(spark, ids.base, ["IS 10 (Part 1) : 1999", "IS  10 : 1999", None]) == ["IS 10", "IS 10", None]
    assert each(spark, ids.base_with_year, ["IS 10 : 1999 (Part 1)"]) == ["IS 10 : 1999"]
    assert each(spark, ids.digits, ["IS 0010 (Part 1) : 1999"]) == ["0010"]
    assert each(spark, ids.parts, ["IS 10118 (Part 2/Sec 1)", "IS 5", "IS 3 Section IV"]) == ["2 1", "", "iv"]
    assert [tuple(x) for x in each(spark, ids.split_year, ["IS 10 : 2012", "IS 10"])] == [("IS 10", 2012), ("IS 10", None)]
    assert each(spark, ids.variants, ["IS 10553 (Part II)", "IS 60947", "IS 5"]) == [["IS 10553 (Part II)", "IS 10553 (Part 2)"], ["IS 60947", "IS/IEC 60947"], ["IS 5"]]
    assert each(spark, ids.year_in, ["DOC/2025/B/6183459", "none"]) == ["2025", "unknown"]


@pytest.mark.parametrize("a, b, near", [("1234", "1243", True), ("1234", "124", True), ("1234", "1235", True), ("1234", "12345", True), ("1234", "1234", False), ("1234", "2143", False), ("12", "21", True)])
def test_one_edit(spark, a, b, near):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(ids.one_edit_apart(F.col("a"), F.col("b"))).first()[0] is near


def test_citations(spark):
    cases = {
        "conforming to relevant IS 10.": [],
        "THIS 20, he is 11, AXIS 400": [],
        "IS/IEC 60947": ["IS 60947"],
        "IS:20161967": ["IS 2016"],
        "IS 123456789": [],
        "IS 1554 (Part 2/Sec 1) IS 1554 (Part-2/ Sec.-1)": ["IS 1554 (Part 2/Sec 1)"],
        "केबल IS 1554 😀IS 694": ["IS 1554", "IS 694"],
        "IS 456. " * 7000: ["IS 456"],
        "": [],
    }
    assert each(spark, citations.extract, cases) == list(cases.values())
    assert each(spark, citations.extract, [None]) == [[]]
    many = " ".join(f"IS {1000 + i}" for i in range(400))
    assert len(each(spark, citations.extract, [many])[0]) == 400
    assert each(spark, citations.foreign, ["to ISO 9001 and BS EN 10025-2, ISO 9001"]) == [["ISO 9001", "BS EN 10025-2"]]
    assert each(spark, citations.demands_mark, ["bears the ISI mark", "CM/L 1", "nothing", None]) == [True, True, False, False]


def test_notifications(spark):
    cases = {"3. Order 2003 dated 17-02-2003 Superseded by X": "Order 2003 dated 17-02-2003", "N/A": "", "": "", "Order (S.O. 1 dated 5 Feb 2001 more": "Order (S.O. 1 dated 5 Feb 2001)", "w " * 150: ("w " * 90).strip() + " …"}
    assert each(spark, citations.notification, cases) == list(cases.values())
    assert each(spark, citations.notification, [None]) == [""]


def test_replacement_keeps_other_words(spark):
    f = lambda c: citations.replace_citation(c, F.lit("IS 303"), F.lit("IS $1"))
    assert each(spark, f, ["IS:303-1989, is 303 : 1990, IS 3031, THIS 303"]) == ["IS $1, IS $1, IS 3031, THIS 303"]
    assert each(spark, lambda c: citations.occurrences(c, F.lit("IS 303")), ["IS 303 IS:303 IS 3030"]) == [2]


def test_text(spark):
    assert each(spark, text.clip, ["a. b", "x" * 1500 + ". " + "y" * 900, None]) == ["a. b", "x" * 1500 + ".", ""]
    assert each(spark, text.expand, ["MS plate", "ms plate", "uPVC pipe", None]) == ["MS plate mild steel", "ms plate", "uPVC pipe unplasticized polyvinyl chloride", ""]
    assert each(spark, text.script, ["क ख text", "க", "text", None]) == ["hi", None, None, None]
    assert each(spark, text.strip_html, ["<p>a &amp;lt; b<script>x<1</script></p><!-- c -->"]) == ["a &lt; b"]
    masked = each(spark, text.masked, ["IS 1554 (Part 1) at 1 100 V, IP66"])
    assert masked == ["{0} at {1}, {2}"]
    back = lambda c: text.restored(c, F.array(F.lit("x"), F.lit("y")))
    assert each(spark, back, ["{0} and {1}", "{1} and {0}", "{0} only", "{0} {0}", "{0} {1} {2}"]) == ["x and y", "y and x", None, None, None]
    assert each(spark, text.sentences, ["One. Two; three? (Four) No"]) == [["One.", "Two; three?", "(Four) No"]]
    assert each(spark, text.is_heading, ["1. SCOPE OF WORK", "A plain line", "SCOPE", "SCOPE.", None]) == [True, False, True, False, False]
    assert each(spark, lambda c: text.shingles(c, 3), ["a b c d", "a b", "A b! c"]) == [["a b c", "b c d"], [], ["a b c"]]


def test_verdicts(spark):
    assert each(spark, verdicts.stated_voltage, ["650/1100 V", "1 100 V", "11 kV", "IS 1554 1.1 kv", "none"]) == [1100, 1100, 11000, 1100, None]
    bands = each(spark, verdicts.voltage_band, ["from 3.3 kV up to and including 11 kV", "up to and including 1 100 V", "cable", None])
    assert [x and (x.low, x.high) for x in bands] == [(3300, 11000), (0, 1100), None, None]
    assert each(spark, verdicts.materials, ["unplasticized PVC", "CPVC and PVC", "cast iron", None]) == [["upvc"], ["cpvc"], ["cast_iron"], []]
    assert each(spark, verdicts.role, ["Methods of test for safety", "Glossary", "Code of practice", "plain", None]) == ["test_method", "terminology", "installation", "product", "product"]
    gate = lambda top, second: spark.range(1).select(verdicts.gate(F.lit(top), F.lit(second)).alias("g")).first().g.reason
    assert [gate(None, None), gate(0.44, 0.0), gate(0.7, 0.65), gate(0.7, 0.6), gate(0.85, 0.84)] == ["no_candidates", "no_close_match", "ambiguous_match", "clear_match", "clear_match"]


def test_values(spark):
    assert each(spark, values.clean_null, [" x ", "", "N/A", "nan", "UNKNOWN", None]) == ["x", None, None, None, None, None]
    assert each(spark, values.listed, ["a; ;b;", "", None]) == [["a", "b"], [], []]
    assert each(spark, values.decade, ["1987", "x", None]) == ["1980", "Unknown", "Unknown"]


def test_forms(spark):
    form = "Bid\nDepartment Name : Works (cid:12)\nOffice Name\n*** **\nMinistry/State Name\nPower\n"
    assert each(spark, lambda c: html.labelled(c, "Department Name"), [form, "", None])[:2] == ["Works", ""]
    assert each(spark, lambda c: html.labelled(c, "Office Name"), [form]) == [""]
    assert each(spark, lambda c: html.labelled(c, "Ministry/State Name"), [form]) == ["Power"]
    assert each(spark, html.category, ["XLPE Cable up to and\n /Item Category\nincluding 33 kV (Q2)\nTotal Quantity/ 5"]) == ["XLPE Cable up to and including 33 kV (Q2)"]
    assert each(spark, html.is_service, ["Manpower hiring", "cable", None]) == [True, False, False]


def test_tables_and_headings(spark):
    page = "<table><tr><td>Cables</td></tr><tr><th>No</th><th>Item</th></tr><tr><td>IS 1554</td><td>PVC<br>cable</td></tr><tr><td>IS 694</td><td>wire</td></tr></table>"
    rows = html.table_rows(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h")
    got = [tuple(r) for r in html.grouped_rows(rows, "k", r"^IS \d+").select("heading", "entry").orderBy("entry").collect()]
    assert got == [("Cables", "IS 1554"), ("Cables", "IS 694")]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["SCOPE OF WORK", "The cable shall", "be laid.", "", "Next one"])], "d int, i int, line string")
    assert [r.text for r in html.wrapped(lines, "d", "i", "line").orderBy("paragraph").collect()] == ["SCOPE OF WORK", "The cable shall be laid.", "Next one"]


def test_typos_are_named_only_with_evidence(spark):
    known = spark.createDataFrame([("8130",), ("5831",)], "s string")
    unknown = spark.createDataFrame([("81304",), ("99999",)], "s string")
    c = resolve.typo_candidates(unknown, "s", known, "s")
    beside = spark.createDataFrame([("81304", "694"), ("99999", "694")], "unknown string, beside string")
    edges = spark.createDataFrame([("694", "8130", 5)], "a string, b string, n int")
    assert [tuple(r) for r in resolve.typo_choice(c, beside, edges).collect()] == [("81304", "8130", 5)]


def test_fixed_values_are_whole():
    assert len(fixed.ROLES) == 6 and len(fixed.MATERIALS) == 13 and len(fixed.SCRIPTS) == 10 and len(fixed.MARK) == 10
    counts = {"EXPANSIONS": 12, "STRICT_EXPANSIONS": 5, "PHRASES": 7, "PROCUREMENT_WORDS": 59, "DECISIONS": 4, "VOCABULARY_STOPS": 37, "STOP_TERMS": 24, "ORDINAL_OWNERS": 6, "GENERIC_TITLES": 9, "UNSEEN": 4}
    assert {k: len(getattr(fixed, k)) for k in counts} == counts
