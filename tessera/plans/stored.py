"""Queries: the register and the bridge as they are stored, classified documents, neighbourhoods by base, reports, pictures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text, verdicts
from ..operators import graph, rollup, titles
from ..sources import sinks, storage, tables
from .base import REG, Tables, query
from .graphs import PARTS, STRONG, supplier_edges


@query(f"WITH {REG} SELECT number, regexp_replace(regexp_replace(number, '[(:].*$', '', 's'), '[^0-9]', '', 'g') AS digits FROM reg")
def register_digits(t: Tables):
    return tables.with_digits(t.register.select("number")).select("number", "digits")


@query(f"WITH {PARTS} SELECT * FROM edges")
def stored_co_citation(t: Tables):
    """The graph from a bridge that is stored in buckets of its documents: mining starts without a shuffle."""
    name = f"bridge_{uuid.uuid4().hex}"
    folder = f"{graph.settled_folder(t.spark)}/{name}"
    bridge = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))
    stored = storage.bucketed(bridge, name, folder, "doc", t.spark.sparkContext.defaultParallelism, "item")
    return graph.co_citation(stored, "doc", "item", 2, places=6, dealt=True)


@query(f"""WITH {REG}, cited AS (SELECT l_orderkey AS doc, l_linenumber AS place, CASE WHEN l_partkey % 97 = 0 THEN 900000 + l_partkey ELSE l_partkey END AS n FROM lineitem),
    rows AS (SELECT doc, place, 'is ' || n || ' : 2001' AS cite, status, family FROM cited LEFT JOIN reg ON pk = n),
    votes AS (SELECT doc, family FROM (SELECT doc, family, count(*) AS c, min(place) AS first FROM rows WHERE family IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY c DESC, first, family) = 1)
    SELECT doc, coalesce(any_value(votes.family), 'Unclassified') AS family, coalesce(string_agg(cite || ' (' || status || ')', '; ' ORDER BY place, cite || ' (' || status || ')') FILTER (status <> 'Current'), '') AS outdated, coalesce(string_agg(cite, '; ' ORDER BY place, cite) FILTER (status IS NULL), '') AS unmatched
    FROM rows LEFT JOIN votes USING (doc) GROUP BY doc""")
def classified_documents(t: Tables):
    n = F.when(F.col("l_partkey") % 97 == 0, 900000 + F.col("l_partkey")).otherwise(F.col("l_partkey"))
    cited = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.concat(F.lit("is "), n, F.lit(" : 2001")).alias("cite"))
    out = rollup.classified(cited, t.register)
    return out.withColumns({"outdated": F.array_join("outdated", "; "), "unmatched": F.array_join("unmatched", "; ")})


@query(f"""WITH {STRONG}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), top AS (SELECT node, dst FROM nodes JOIN edges ON src = node OR src = node - node % 10 QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, co DESC, dst, src) <= 3),
    one AS (SELECT DISTINCT dst AS node FROM top WHERE node = 13 AND dst <> 13), two AS (SELECT DISTINCT dst AS node FROM top WHERE node IN (SELECT node FROM one) AND dst <> 13 AND dst NOT IN (SELECT node FROM one))
    SELECT CAST(13 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def neighbourhood_by_base(t: Tables):
    """Suppliers of ten share a base: their own edges and those of the base count."""
    return graph.neighbourhood(supplier_edges(t), 13, 2, 3, lambda n: n - n % 10)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority AS section, '<h2>' || o_orderpriority || '</h2>' || chr(10) || '<table><tr><th>o_orderkey</th><th>o_orderstatus</th></tr>' || chr(10) || string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td></tr>', chr(10) ORDER BY r) || chr(10) || '</table>'
        || CASE WHEN any_value(n) > 50 THEN chr(10) || '<p>and ' || (any_value(n) - 50) || ' more</p>' ELSE '' END AS html FROM r WHERE r <= 50 GROUP BY o_orderpriority""")
def report_sections(t: Tables):
    return sinks.html_report(t.orders, "o_orderpriority", ["o_orderkey", "o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 50)


@query("""WITH p AS (SELECT c_custkey AS node, (c_custkey * 7919) % 1009 AS x, (c_custkey * 104729) % 641 AS y FROM customer),
    gaps AS (SELECT a.node, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS gap FROM p a JOIN p b ON a.node <> b.node AND abs(floor(a.x / 40.0) - floor(b.x / 40.0)) <= 1 AND abs(floor(a.y / 40.0) - floor(b.y / 40.0)) <= 1 GROUP BY a.node)
    SELECT round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 3) AS spread_x, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 3) AS spread_y, (SELECT round(quantile_cont(gap, 0.5), 3) FROM gaps) AS median_gap FROM p""")
def picture_quality(t: Tables):
    places = t.customer.select(F.col("c_custkey").alias("node"), ((F.col("c_custkey") * 7919) % 1009).cast("double").alias("x"), ((F.col("c_custkey") * 104729) % 641).cast("double").alias("y"))
    return graph.layout_quality(places)


_RULES = [(k, v) for rules in (fixed.EXPANSIONS, fixed.STRICT_EXPANSIONS, fixed.PHRASES) for k, v in rules.items()]
_VALUES = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in _RULES)


@query(f"""WITH rules(key, "full") AS (VALUES {_VALUES}), said AS (SELECT lower(p_type || ' ' || p_name) || CASE WHEN p_partkey % 5 = 0 THEN ' of steel, insulated' ELSE '' END AS t FROM part)
    SELECT key, "full" FROM rules WHERE NOT EXISTS (SELECT 1 FROM said WHERE contains(t, lower("full")) OR contains(t, string_split_regex(trim(regexp_replace(lower("full"), '[^a-z ]', '', 'g')), ' +')[1]))""")
def ungrounded_expansions(t: Tables):
    """Expansions that no title bears out; some titles speak of steel and of what is insulated."""
    said = F.concat("p_type", F.lit(" "), "p_name", F.when(F.col("p_partkey") % 5 == 0, " of steel, insulated").otherwise(""))
    return titles.ungrounded(t.part.select(said.alias("title")), "title")


@query(r"""SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) * 4000 > 26214400 THEN 'upload' WHEN length(coalesce(text, '')) * 80 > 400000 THEN 'text' WHEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) > 600 THEN 'strings' WHEN length(coalesce(text, '')) * 6 > 18000 THEN 'repair' END AS fault FROM documents""")
def size_faults(t: Tables):
    """Bounds of requests over whole texts, with factors that let each bound be met."""
    body = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(body, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    return t.documents.select("doc_id", verdicts.size_fault(F.octet_length(body) * 4000, F.char_length(body) * 80, words, F.char_length(body) * 6).alias("fault"))


@query(r"""WITH p AS (SELECT page_id, coalesce(html, '') || CASE page_id % 3 WHEN 0 THEN '<form><textarea>two</textarea><input value="three">four</form>' WHEN 1 THEN '<noscript>five</noscript> six' ELSE '' END AS h FROM pages), a AS (SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g') AS h FROM p),
    b AS (SELECT page_id, regexp_replace(h, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|noscript\b[^>]*>.*?</noscript|textarea\b[^>]*>.*?</textarea)\s*>', ' ', 'g') AS h FROM a), c AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM b)
    SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), 300000) AS seen FROM c""")
def page_scan(t: Tables):
    """Pages as they are read, with forms and hidden parts that don't count."""
    k = F.col("page_id") % 3
    form = F.when(k == 0, '<form><textarea>two</textarea><input value="three">four</form>').when(k == 1, "<noscript>five</noscript> six").otherwise("")
    return t.pages.select("page_id", text.page_text(F.concat(F.coalesce("html", F.lit("")), form)).alias("seen"))
