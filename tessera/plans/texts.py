"""Queries: text functions, verdicts, repair, HTML and documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations, fixed, text, values, verdicts
from ..operators import lineage, repair
from ..sources import html
from .base import Tables, inside, inside_sql, query

TITLES = """titles AS (SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 0 THEN 'Methods of test for ' || p_name WHEN 1 THEN 'Glossary of terms for ' || p_name WHEN 2 THEN 'Code of practice for laying of ' || p_name
    WHEN 3 THEN 'Safety of UPVC ' || p_name WHEN 4 THEN 'Dimensions of cast iron ' || p_name WHEN 5 THEN 'Inspection of mild steel ' || p_name WHEN 6 THEN 'PVC insulated cables for working voltages up to and including ' || (p_size * 100) || ' V'
    WHEN 7 THEN 'XLPE cables from 3.3 kV up to and including ' || p_size || ' kV' WHEN 8 THEN 'HDPE pipes, ' || p_name WHEN 9 THEN 'Unplasticized PVC pipes, ' || p_name WHEN 10 THEN 'Ductile iron and rubber ' || p_name ELSE p_name END AS title,
    CASE p_partkey % 5 WHEN 0 THEN 'PVC cable rated 650/1100 V' WHEN 1 THEN 'testing of XLPE cable 11 kV' WHEN 2 THEN 'code of practice for GI pipe' WHEN 3 THEN 'uPVC pipe 1 100 V' ELSE 'plain ring' END AS q FROM part)"""


def titles(t: Tables):
    k, n, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    forms = [F.concat(F.lit("Methods of test for "), n), F.concat(F.lit("Glossary of terms for "), n), F.concat(F.lit("Code of practice for laying of "), n), F.concat(F.lit("Safety of UPVC "), n), F.concat(F.lit("Dimensions of cast iron "), n), F.concat(F.lit("Inspection of mild steel "), n), F.concat(F.lit("PVC insulated cables for working voltages up to and including "), (size * 100).cast("string"), F.lit(" V")), F.concat(F.lit("XLPE cables from 3.3 kV up to and including "), size.cast("string"), F.lit(" kV")), F.concat(F.lit("HDPE pipes, "), n), F.concat(F.lit("Unplasticized PVC pipes, "), n), F.concat(F.lit("Ductile iron and rubber "), n)]
    title = n
    for i, f in reversed(list(enumerate(forms))):
        title = F.when(k % 12 == i, f).otherwise(title)
    q = F.when(k % 5 == 0, "PVC cable rated 650/1100 V").when(k % 5 == 1, "testing of XLPE cable 11 kV").when(k % 5 == 2, "code of practice for GI pipe").when(k % 5 == 3, "uPVC pipe 1 100 V").otherwise("plain ring")
    return t.part.select(k.alias("k"), title.alias("title"), q.alias("q"), size.alias("size"))


@query(f"""WITH {TITLES} SELECT k, CASE k % 12 WHEN 0 THEN 'test_method' WHEN 1 THEN 'terminology' WHEN 2 THEN 'installation' WHEN 3 THEN 'safety' WHEN 4 THEN 'dimensions' WHEN 5 THEN 'quality_system' ELSE 'product' END AS role,
    CASE k % 5 WHEN 1 THEN 'test_method' WHEN 2 THEN 'installation' ELSE 'product' END AS wanted FROM titles""")
def role_classifier(t: Tables):
    return titles(t).select("k", verdicts.role(F.col("title")).alias("role"), verdicts.wanted_role(F.col("q")).alias("wanted"))


@query(f"""WITH {TITLES} SELECT k, CASE k % 12 WHEN 3 THEN 'upvc' WHEN 4 THEN 'cast_iron' WHEN 5 THEN 'steel' WHEN 6 THEN 'pvc' WHEN 7 THEN 'xlpe' WHEN 8 THEN 'hdpe' WHEN 9 THEN 'upvc' WHEN 10 THEN 'ductile_iron elastomer' ELSE '' END AS materials,
    CASE k % 5 WHEN 0 THEN 'pvc' WHEN 1 THEN 'xlpe' WHEN 2 THEN 'steel' WHEN 3 THEN 'upvc' ELSE '' END AS asked FROM titles""")
def material_flags(t: Tables):
    return titles(t).select("k", F.array_join(verdicts.materials(F.col("title")), " ").alias("materials"), F.array_join(verdicts.materials(F.col("q")), " ").alias("asked"))


@query("""WITH b AS (SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 6 THEN 0.0 WHEN 7 THEN 3300.0 END AS low, CASE p_partkey % 12 WHEN 6 THEN p_size * 100.0 WHEN 7 THEN p_size * 1000.0 END AS high,
        CASE p_partkey % 5 WHEN 0 THEN 1100.0 WHEN 1 THEN 11000.0 WHEN 3 THEN 1100.0 END AS stated FROM part)
    SELECT k, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(stated AS DOUBLE) AS stated, CASE WHEN low IS NULL OR stated IS NULL THEN 'not_declared' WHEN low <= stated AND stated <= high THEN 'in_band' ELSE 'out_of_band' END AS verdict FROM b""")
def voltage_verdicts(t: Tables):
    b = verdicts.voltage_band(F.col("title"))
    return titles(t).select("k", b["low"].alias("low"), b["high"].alias("high"), verdicts.stated_voltage(F.col("q")).alias("stated"), verdicts.voltage_verdict(F.col("q"), F.col("title")).alias("verdict"))


@query(f"""WITH {TITLES}, v AS (SELECT k, k % 5 AS qn, k % 12 AS tn, 1.0 / (1 + k % 7) AS score, CASE k % 4 WHEN 0 THEN 'Current' WHEN 1 THEN 'Superseded' WHEN 2 THEN 'Withdrawn' END AS status FROM titles),
    m AS (SELECT *, CASE qn WHEN 0 THEN 'pvc' WHEN 1 THEN 'xlpe' WHEN 2 THEN 'steel' WHEN 3 THEN 'upvc' END AS a, CASE tn WHEN 3 THEN 'upvc' WHEN 4 THEN 'cast_iron' WHEN 5 THEN 'steel' WHEN 6 THEN 'pvc' WHEN 7 THEN 'xlpe' WHEN 8 THEN 'hdpe' WHEN 9 THEN 'upvc' WHEN 10 THEN 'ductile_iron' END AS b,
        CASE qn WHEN 1 THEN 'test_method' WHEN 2 THEN 'installation' ELSE 'product' END AS w, CASE tn WHEN 0 THEN 'test_method' WHEN 1 THEN 'terminology' WHEN 2 THEN 'installation' WHEN 3 THEN 'safety' WHEN 4 THEN 'dimensions' WHEN 5 THEN 'quality_system' ELSE 'product' END AS r FROM v)
    SELECT k, row_number() OVER (PARTITION BY qn ORDER BY CASE WHEN a IS NULL OR b IS NULL THEN 1 WHEN a = b OR (a = 'pvc' AND b = 'upvc') OR (a = 'upvc' AND b = 'pvc') THEN 0 ELSE 2 END,
        CASE WHEN (w = 'product' AND r NOT IN ('terminology', 'installation')) OR (w <> 'product' AND w = r) THEN 0 ELSE 1 END, CASE status WHEN 'Current' THEN 0 WHEN 'Superseded' THEN 1 WHEN 'Withdrawn' THEN 2 ELSE 3 END, score DESC, k) AS place FROM m""")
def final_rank(t: Tables):
    return ranked(titles(t))


def ranked(of: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    c = of.withColumn("score", 1.0 / (1 + F.col("k") % 7)).withColumn("status", F.when(F.col("k") % 4 == 0, "Current").when(F.col("k") % 4 == 1, "Superseded").when(F.col("k") % 4 == 2, "Withdrawn"))
    order = verdicts.final_order(F.lit("not_declared"), verdicts.material_verdict(F.col("q"), F.col("title")), verdicts.role_verdict(F.col("q"), F.col("title")), F.col("status"), F.col("score"), F.col("k"))
    return c.select("k", F.row_number().over(Window.partitionBy(F.col("k") % 5).orderBy(*order)).alias("place"))


CASES = """CASE doc_id % 8 WHEN 0 THEN 'as per relevant IS 10. See IS 694 and IS ' || (1000 + doc_id) WHEN 1 THEN 'THIS 20 and he is 11, IS:20161967' WHEN 2 THEN 'IS/IEC 60947 (Part 1), IS 60947 (part-1)'
    WHEN 3 THEN 'IS 1554 (Part 2/ Sec 1) then IS 1554 (Part-2/Sec.-1)' WHEN 4 THEN 'IS 99999999 and IS 8' WHEN 5 THEN repeat('IS 456. ', 50) WHEN 6 THEN 'to IS ' || (10 + doc_id) || ' (Part ' || (doc_id % 9) || '), IS ' || (10 + doc_id) || ' and IS ' || doc_id || '2001' ELSE '' END"""


@query(rf"""WITH t AS ({inside_sql(CASES)}), c AS (SELECT doc_id, regexp_replace(t, '\b(relevant|applicable|respective|appropriate|any other) IS', '\1 XX', 'g') AS t FROM t),
    m AS (SELECT doc_id, regexp_extract_all(t, '(?:^|[^A-Za-z])IS(?:/(?:IEC|ISO))?[:\s]*(\d{{2,}})(?:\s*\(([^)]{{0,40}})\))?', 1) AS n, regexp_extract_all(t, '(?:^|[^A-Za-z])IS(?:/(?:IEC|ISO))?[:\s]*(\d{{2,}})(?:\s*\(([^)]{{0,40}})\))?', 2) AS p FROM c),
    x AS (SELECT doc_id, list_filter(list_transform(list_zip(n, p), lambda z: {{'n': CASE WHEN length(z[1]) <= 6 THEN z[1] ELSE regexp_extract(z[1], '^(\d{{2,6}})((?:19|20)\d{{2}})$', 1) END, 'p': trim(regexp_replace(coalesce(z[2], ''), '\s+', ' ', 'g'))}}), lambda z: z.n <> '') AS x FROM m),
    k AS (SELECT doc_id, x, list_transform(x, lambda z: z.n || '|' || regexp_replace(lower(z.p), '[^a-z0-9]', '', 'g')) AS k FROM x)
    SELECT doc_id, array_to_string(list_transform(list_filter(x, lambda z, i: list_position(k, k[i]) = i), lambda z: CASE WHEN z.p = '' THEN 'IS ' || z.n ELSE 'IS ' || z.n || ' (' || z.p || ')' END), '; ') AS found FROM k""")
def citation_extraction(t: Tables):
    """Whole texts with designations at varied places."""
    k = F.col("doc_id")
    number = lambda c: c.cast("string")
    case = F.when(k % 8 == 0, F.concat(F.lit("as per relevant IS 10. See IS 694 and IS "), number(k + 1000))).when(k % 8 == 1, "THIS 20 and he is 11, IS:20161967").when(k % 8 == 2, "IS/IEC 60947 (Part 1), IS 60947 (part-1)").when(k % 8 == 3, "IS 1554 (Part 2/ Sec 1) then IS 1554 (Part-2/Sec.-1)").when(k % 8 == 4, "IS 99999999 and IS 8").when(k % 8 == 5, "IS 456. " * 50)
    case = case.when(k % 8 == 6, F.concat(F.lit("to IS "), number(k + 10), F.lit(" (Part "), number(k % 9), F.lit("), IS "), number(k + 10), F.lit(" and IS "), number(k), F.lit("2001"))).otherwise("")
    return t.documents.select("doc_id", F.array_join(citations.extract(inside(case)), "; ").alias("found"))


_GUARDED = inside_sql("'conform to IS ' || (10 + doc_id % 7) || ' : ' || (2005 + doc_id % 9) || ', is ' || (20 + doc_id % 5) || ' and IS:10 (Part 1) - 1999'")


@query(rf"""WITH t AS ({_GUARDED}), f AS (SELECT doc_id, regexp_extract_all(t, '(?i)\bIS[:\s]*(\d{{2,6}})(?:\s*\([^)]{{0,40}}\))?(?:\s*[:\-]\s*((?:19|20)\d{{2}}))?', 1) AS n, regexp_extract_all(t, '(?i)\bIS[:\s]*(\d{{2,6}})(?:\s*\([^)]{{0,40}}\))?(?:\s*[:\-]\s*((?:19|20)\d{{2}}))?', 2) AS y FROM t)
    SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(n, y), lambda x: x[1] NOT IN ('10', '12', '14', '20', '22') OR (x[1] IN ('10', '12') AND coalesce(x[2], '') NOT IN ('', '2010'))), lambda x: 'IS ' || x[1] || CASE WHEN x[1] IN ('10', '12', '14', '20', '22') THEN ':' || x[2] ELSE '' END), '; ') AS leaks FROM f""")
def subset_guard(t: Tables):
    """Whole texts with designations that may and may not stand there, and years that are and aren't those on record."""
    k = F.col("doc_id")
    said = F.concat(F.lit("conform to IS "), k % 7 + 10, F.lit(" : "), k % 9 + 2005, F.lit(", is "), k % 5 + 20, F.lit(" and IS:10 (Part 1) - 1999"))
    allowed = F.array(*[F.lit(f"IS {n} (Part 1)") for n in (10, 12, 14, 20, 22)])
    years = F.create_map(F.lit("10"), F.lit("2010"), F.lit("12"), F.lit("2010"))
    return t.documents.select("doc_id", F.array_join(citations.leaked(inside(said), allowed, years), "; ").alias("leaks"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Order, S.O. ' || p_partkey || '(E) dated 17-02-2003' WHEN 1 THEN 'Order ' || p_partkey WHEN 2 THEN 'Order (' || p_partkey || ' dated 5 Feb 2001)' ELSE '' END AS notice FROM part""")
def notification_trim(t: Tables):
    k = F.col("p_partkey").cast("string")
    n = F.col("p_partkey") % 4
    raw = F.when(n == 0, F.concat(F.lit("12. Order,  S.O. "), k, F.lit("(E) dated 17-02-2003 and S.O. 9(E) dated 1-1-2004"))).when(n == 1, F.concat(F.lit("Order "), k, F.lit(", Superseded by Order 7 dated 1-1-2010"))).when(n == 2, F.concat(F.lit("Order ("), k, F.lit(" dated 5 Feb 2001 as later said"))).otherwise("N/A")
    return t.part.select(F.col("p_partkey").alias("k"), citations.notification(raw).alias("notice"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM a)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM b""")
def html_visible_text(t: Tables):
    return t.pages.select("page_id", text.strip_html(F.col("html")).alias("visible"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']*)["'']', 1, 'i')) AS u, generate_subscripts(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']*)["'']', 1, 'i'), 1) AS i FROM pages),
    f AS (SELECT page_id, u, min(i) AS i FROM l WHERE starts_with(u, '/') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM f)
    SELECT p.page_id, coalesce(string_agg(u, ' ' ORDER BY i) FILTER (r <= 8), '') AS links FROM pages p LEFT JOIN k USING (page_id) GROUP BY 1""")
def html_links(t: Tables):
    return t.pages.select("page_id", F.array_join(text.links(F.col("html"), 8, "^/"), " ").alias("links"))


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents""")
def tokenised(t: Tables):
    w = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


def _expansion_sql() -> str:
    """The rules of fixed values as a list of cases, in their order; the words' fences as characters, as look-around is not at hand."""
    fence = lambda w: f"(^|[^A-Za-z0-9]){re.escape(w)}([^A-Za-z0-9]|$)"
    rules = [("(?i)" + fence(k), v) for k, v in fixed.EXPANSIONS.items()] + [(fence(k), v) for k, v in fixed.STRICT_EXPANSIONS.items()] + [("(?i)" + k, v) for k, v in fixed.PHRASES.items()]
    cases = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{v}' END" for p, v in rules)
    return f"""WITH q AS (SELECT doc_id, concat_ws(chr(10), text, CASE doc_id % 5 WHEN 0 THEN 'XLPE cable' WHEN 1 THEN 'MS and ms pipe' WHEN 2 THEN 'street lighting' WHEN 3 THEN 'gi GI galvanized iron' ELSE '' END) AS q FROM documents),
        e AS (SELECT doc_id, q, list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM q)
        SELECT doc_id, CASE WHEN len(l) = 0 THEN q ELSE q || ' ' || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') END AS expanded FROM e"""


@query(_expansion_sql())
def query_expansion(t: Tables):
    """Whole texts of all documents, with some cases behind them."""
    k = F.col("doc_id")
    case = F.when(k % 5 == 0, "XLPE cable").when(k % 5 == 1, "MS and ms pipe").when(k % 5 == 2, "street lighting").when(k % 5 == 3, "gi GI galvanized iron").otherwise("")
    return t.documents.select("doc_id", text.expand(F.concat_ws("\n", "text", case)).alias("expanded"))


@query(r"""WITH c AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), h AS (SELECT doc_id, t, left(t, 500) AS h FROM c), p AS (SELECT *, greatest(CASE WHEN contains(h, '. ') THEN length(h) - strpos(reverse(h), ' .') ELSE 0 END, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) + 1 ELSE 0 END) AS n FROM h)
    SELECT doc_id, length(CASE WHEN length(t) <= 500 THEN t WHEN n > 301 THEN trim(left(t, n), ' ') ELSE trim(h, ' ') END) AS kept FROM p""")
def clipped(t: Tables):
    return t.documents.select("doc_id", F.char_length(text.clip(F.col("text"), 500)).alias("kept"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'ta' WHEN 2 THEN NULL ELSE NULL END AS script FROM documents""")
def script_detection(t: Tables):
    k = F.col("doc_id")
    c = F.when(k % 4 == 0, F.concat(F.lit("केबल तार "), F.col("text"))).when(k % 4 == 1, "கம்பி क").when(k % 4 == 2, F.concat(F.lit("क "), F.col("text"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", text.script(c).alias("script"))


@query("""SELECT doc_id, 'replace IS 1554 (Part 1) by {n}' AS form, true AS lossless FROM documents WHERE doc_id < 0 UNION ALL SELECT doc_id, 'See {0} at {1} in {2}. ' || doc_id, true FROM documents""")
def placeholders(t: Tables):
    said = F.concat(F.lit("See IS 1554 (Part 1) at 11 kV in IP66. "), F.col("doc_id").cast("string"))
    m = text.masked(said)
    return t.documents.select("doc_id", m.alias("form"), (text.restored(m, text.protected(said)) == said).alias("lossless"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '([.;?!])\s+([A-Z{("''])', '\1' || chr(1) || '\2', 'g') AS t FROM documents)
    SELECT doc_id, length(t) - length(replace(t, chr(1), '')) + 1 AS sentences FROM s""")
def sentence_split(t: Tables):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations""")
def heading_fill_forward(t: Tables):
    c = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked_at"))
    return html.filled_down(c, ["conv_id"], ["turn"], ["asked_at"])


HEADING = lambda c: rf"(length(trim({c})) <= 92 AND NOT ends_with(trim({c}), '.') AND length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 0 AND ((regexp_matches(trim({c}), '^(\d+(\.\d+)*)[.)]?\s+(.{{2,90}})$') AND length(regexp_replace({c}, '[^A-Z]', '', 'g')) / length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 0.6) OR (length(regexp_replace({c}, '[^A-Z]', '', 'g')) / length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 0.85 AND len(regexp_split_to_array(trim({c}), '\s+')) <= 12)))"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '2.1 SCOPE OF WORK' || chr(10) || 'goes on' ELSE '' END, chr(10))) AS line, generate_subscripts(string_split(text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '2.1 SCOPE OF WORK' || chr(10) || 'goes on' ELSE '' END, chr(10)), 1) AS i FROM documents),
    b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
    s AS (SELECT doc_id, i, line, CASE WHEN before IS NULL OR trim(before) = '' OR regexp_matches(trim(before), '[.:;?!]$') OR coalesce({HEADING('line')}, false) OR coalesce({HEADING('before')}, false) THEN 1 ELSE 0 END AS s FROM b),
    p AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph FROM s)
    SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, string_agg(trim(line), ' ' ORDER BY i) AS text FROM p WHERE trim(line) <> '' GROUP BY ALL""")
def run_grouping(t: Tables):
    """The lines of whole texts as paragraphs."""
    whole = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\n2.1 SCOPE OF WORK\ngoes on").otherwise(""))
    lines = t.documents.select("doc_id", F.posexplode(F.split(whole, "\n")).alias("i", "line"))
    return html.wrapped(lines, "doc_id", "i", "line")


_LAID = inside_sql("'Lay IS:303-1989 : 2013 as in is 456:1978 and THIS 303, then IS ' || (300 + doc_id % 9) || '.'")


@query(rf"""WITH t AS ({_LAID}) SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)(^|[^A-Za-z])IS[:\s]*303(?:\s*[:\-]\s*\d{{4}})?', '\1IS 8130', 'g'), '(?i)(^|[^A-Za-z])IS[:\s]*456(?:\s*[:\-]\s*\d{{4}})?', '\1IS 456', 'g') AS fixed,
    CASE WHEN doc_id % 2 = 0 THEN 'Additional entries applicable: IS 99.' ELSE '' END AS tail FROM t""")
def repair_substitution(t: Tables):
    docs = t.documents.select("doc_id", inside(F.concat(F.lit("Lay IS:303-1989 : 2013 as in is 456:1978 and THIS 303, then IS "), F.col("doc_id") % 9 + 300, F.lit("."))).alias("text"))
    one = docs.select(F.col("doc_id").alias("doc"), F.lit("replace").alias("action"), F.lit("IS 303").alias("old"), F.lit("IS 8130").alias("new"))
    two = one.withColumns({"old": F.lit("IS 456"), "new": F.lit("IS 456")})
    add = one.filter("doc % 2 = 0").withColumns({"action": F.lit("add"), "old": F.lit(None).cast("string"), "new": F.lit("IS 99")})
    out = repair.substituted(docs, "doc_id", "text", one.unionByName(two))
    return out.join(repair.tail(one.unionByName(add)).withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "fixed", F.coalesce("tail", F.lit("")).alias("tail"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'not_a_clause' WHEN 2 THEN 'obligation_on_person_not_goods' WHEN 3 THEN 'invented_certification_duty' WHEN 4 THEN 'unsupported_permissive_claim' END AS fault FROM documents""")
def prose_guard(t: Tables):
    k = F.col("doc_id")
    said = F.when(k % 6 == 0, "  ").when(k % 6 == 1, "Sorry, no.").when(k % 6 == 2, "The supplier shall also ensure that IS 10 is met.").when(k % 6 == 3, "Goods to IS 10 shall be certified.").when(k % 6 == 4, "IS 10 is merely advisory.").otherwise("Goods shall conform to IS 10.")
    leaks = citations.leaked(said, F.array(F.lit("IS 10")))
    return t.documents.select("doc_id", verdicts.prose_fault(said, F.lit(False), leaks, F.lit("IS 10 (Part 2)")).alias("fault"))


SETS = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id AS doc, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tok WHERE len(w) >= 5)),
    sz AS (SELECT doc, count(*) AS n, hash(list(s ORDER BY s)) AS h FROM sh GROUP BY 1 HAVING count(*) >= 40),
    kin AS (SELECT doc, n, min(doc) OVER (PARTITION BY h) AS first FROM sz),
    inter AS (SELECT x.doc AS a, y.doc AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc < y.doc WHERE x.doc IN (SELECT doc FROM kin WHERE doc = first) AND y.doc IN (SELECT doc FROM kin WHERE doc = first) GROUP BY ALL),
    near AS (SELECT a, b, round(i / (p.n + q.n - i), 6) AS jaccard FROM inter JOIN kin p ON p.doc = a JOIN kin q ON q.doc = b UNION ALL SELECT first, doc, 1.0 FROM kin WHERE doc <> first)"""


@query(f"WITH {SETS} SELECT a, b, jaccard FROM near WHERE jaccard >= 0.8")
def near_duplicate_pairs(t: Tables):
    return lineage.near_pairs(t.documents, "doc_id", "text")


@query(f"""WITH RECURSIVE {SETS}, st AS (SELECT a AS u, b AS v FROM near WHERE jaccard >= 0.8 UNION SELECT b, a FROM near WHERE jaccard >= 0.8),
    reach(u, v) AS (SELECT u, u FROM st UNION SELECT r.u, st.v FROM reach r JOIN st ON r.v = st.u) SELECT u AS doc, min(v) AS cluster FROM reach GROUP BY u""")
def near_duplicate_clusters(t: Tables):
    return lineage.clusters(lineage.near_pairs(t.documents, "doc_id", "text"))


@query(f"""WITH RECURSIVE {SETS}, th AS (SELECT unnest([0.8, 0.65, 0.5, 0.35]) AS t), st AS (SELECT t, a AS u, b AS v FROM near, th WHERE jaccard >= t UNION SELECT t, b, a FROM near, th WHERE jaccard >= t),
    reach(t, u, v) AS (SELECT t, u, u FROM st UNION SELECT r.t, r.u, st.v FROM reach r JOIN st ON r.v = st.u AND r.t = st.t), c AS (SELECT t, u, min(v) AS m FROM reach GROUP BY t, u)
    SELECT CAST(t AS DOUBLE) AS threshold, count(DISTINCT m) AS clusters, count(*) AS docs FROM c GROUP BY t""")
def lineage_sweep(t: Tables):
    pairs = lineage.settled(lineage.near_pairs(t.documents, "doc_id", "text", min(fixed.SWEEP)))
    return lineage.sweep(pairs, fixed.SWEEP)


@query("""WITH g AS (SELECT min(doc_id) AS doc_id, text, count(*) AS n FROM documents GROUP BY text) SELECT doc_id, n FROM g""")
def exact_duplicate_groups(t: Tables):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS clean, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_size >= 33 THEN 'High' WHEN p_size >= 20 THEN 'Medium' ELSE 'Low' END AS band FROM part""")
def null_and_band_rules(t: Tables):
    raw = F.when(F.col("p_size") % 5 == 0, F.element_at(F.array(*[F.lit(x) for x in ("N/A", " nan ", "None", "UNKNOWN", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    names = F.when(F.col("p_size") % 5 == 0, " ; ").otherwise("a; b ;")
    return t.part.select(F.col("p_partkey").alias("k"), values.clean_null(raw).alias("clean"), F.size(values.listed(names)).alias("n"), values.band(F.col("p_size") / 50.0 - 0.0).alias("band"))
