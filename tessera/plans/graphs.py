"""Queries: the co-citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, checks, graph
from ..operators.lookup import bars
from ..operators.plumbing import over_tasks
from .base import BRIDGE, REG, Tables, query


def edges_sql(bridge: str, least_co: int, conf: float, source: int) -> str:
    """Named table expression ``edges`` over a bridge (doc, item)."""
    return f"""n AS (SELECT item, count(*) AS n FROM {bridge} GROUP BY item), total AS (SELECT count(DISTINCT doc) AS t FROM {bridge}),
    pairs AS (SELECT x.item AS src, y.item AS dst, count(*) AS co FROM {bridge} x JOIN {bridge} y ON x.doc = y.doc AND x.item <> y.item GROUP BY ALL HAVING count(*) >= {least_co}),
    edges AS (SELECT src, dst, a.n AS n_src, b.n AS n_dst, co, round(co / a.n, 6) AS confidence, round((co / t) / ((a.n / t) * (b.n / t)), 6) AS lift
        FROM pairs JOIN n a ON a.item = src JOIN n b ON b.item = dst, total WHERE a.n >= {source} AND co / a.n >= {conf})"""


SUPPLIERS = "sup AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS item FROM lineitem)"
PARTS = f"{BRIDGE}, {edges_sql('bridge', 2, 0.0, 1)}"
STRONG = f"{SUPPLIERS}, {edges_sql('sup', 20, 0.03, 100)}"
UNDIRECTED = """und AS (SELECT a, b, src, dst, co, confidence, lift FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, *,
    row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY confidence DESC, src) AS r FROM edges) WHERE r = 1)"""
CAPPED = """ends AS (SELECT a, b, a AS e, co FROM und UNION ALL SELECT a, b, b, co FROM und),
    kept AS (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY co DESC, a, b) AS r FROM ends) WHERE r <= {cap}),
    cap AS (SELECT und.* FROM und JOIN kept USING (a, b))"""


def citing(t: Tables):
    """The bridge as it lies: mining takes repeated rows once, and counts rows where nothing is shuffled."""
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))


def part_edges(t: Tables):
    return graph.co_citation(citing(t), "doc", "item", 2, places=6)


def stored_part_edges(t: Tables):
    """The edges, and over how many tasks these and the parts are dealt."""
    return graph.stored(part_edges(t), t.part)


def supplier_edges(t: Tables):
    return graph.co_citation(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("item")), "doc", "item", 20, 0.03, 100, places=6)


@query(f"WITH {PARTS} SELECT * FROM edges")
def co_citation_edges(t: Tables):
    return part_edges(t)


@query(f"WITH {STRONG} SELECT * FROM edges")
def co_citation_supplier_thresholds(t: Tables):
    return supplier_edges(t)


@query(f"WITH {PARTS} SELECT src, dst, co || ' of ' || n_src || ' documents that cite ' || src || ' also cite ' || dst AS evidence FROM edges")
def evidence_statements(t: Tables):
    return part_edges(t).select("src", "dst", graph.evidence_statement(F.col("src"), F.col("dst"), F.col("co"), F.col("n_src")).alias("evidence"))


@query(f"WITH {PARTS}, {UNDIRECTED} SELECT * FROM und")
def graph_undirected_best_direction(t: Tables):
    return graph.undirected(*stored_part_edges(t))


@query(f"WITH {PARTS}, {UNDIRECTED}, {CAPPED.format(cap=3)} SELECT a, b, co FROM cap")
def graph_edge_cap(t: Tables):
    edges, parts = stored_part_edges(t)
    return graph.edge_cap(graph.undirected(edges, parts), 3, parts).select("a", "b", "co")


@query(f"WITH {PARTS} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def graph_degree_top(t: Tables):
    edges, parts = stored_part_edges(t)
    return graph.degrees(edges, parts=parts).orderBy(F.desc("degree"), "node").limit(10)


@query(f"""WITH {PARTS}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, node LIMIT 300)
    SELECT src, dst, co FROM edges WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)""")
def graph_densest(t: Tables):
    edges, parts = stored_part_edges(t)
    return graph.densest(edges, 300, parts=parts).select("src", "dst", "co")


@query(f"""WITH RECURSIVE {STRONG}, top AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, co DESC, dst) AS r FROM edges) WHERE r <= 3),
    one AS (SELECT dst AS node FROM top WHERE src = 1 AND dst <> 1), two AS (SELECT DISTINCT dst AS node FROM top WHERE src IN (SELECT node FROM one) AND dst <> 1 AND dst NOT IN (SELECT node FROM one))
    SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def graph_neighbourhood_2hop(t: Tables):
    return graph.neighbourhood(supplier_edges(t), 1, 2, 3)


@query(f"""WITH RECURSIVE {STRONG}, {UNDIRECTED}, {CAPPED.format(cap=2)}, st AS (SELECT a AS u, b AS v FROM cap UNION SELECT b, a FROM cap),
    bfs(node, hop) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT v, hop + 1 FROM bfs JOIN st ON u = node WHERE hop < (SELECT count(DISTINCT u) FROM st))
    SELECT (SELECT min(hop) FROM bfs WHERE node = 50) AS hops""")
def graph_shortest_path(t: Tables):
    edges, parts = graph.stored(supplier_edges(t))
    pairs = graph.settled(graph.edge_cap(graph.undirected(edges, parts), 2, parts))
    return graph.shortest_path(pairs, 1, 50).select("hops")


@query("""WITH RECURSIVE st AS (SELECT p_partkey AS u, p_partkey + 1 AS v FROM part UNION ALL SELECT p_partkey + 1, p_partkey FROM part UNION ALL
        SELECT p_partkey, p_partkey + 4 FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey + 4, p_partkey FROM part WHERE p_partkey % 7 = 0),
    bfs(node, hop) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT v, hop + 1 FROM bfs JOIN st ON u = node WHERE hop < 80) SELECT CAST(min(hop) AS INT) AS hops FROM bfs WHERE node = 22""")
def graph_long_path(t: Tables):
    """A chain of parts with short cuts: the ends are more than eight steps apart."""
    p = t.part.select(F.col("p_partkey").alias("a"))
    pairs = p.withColumn("b", F.col("a") + 1).unionByName(p.filter("a % 7 = 0").withColumn("b", F.col("a") + 4))
    return graph.shortest_path(pairs, 1, 22).select("hops")


@query(f"WITH {STRONG}, {UNDIRECTED}, {CAPPED.format(cap=2)} SELECT a, b, CASE WHEN a = 7 THEN b ELSE a END AS other FROM cap WHERE a = 7 OR b = 7")
def graph_ego(t: Tables):
    edges, parts = graph.stored(supplier_edges(t))
    return graph.ego(graph.edge_cap(graph.undirected(edges, parts), 2, parts), 7).select("a", "b", "other")


@query(f"""WITH RECURSIVE {BRIDGE}, {edges_sql('bridge', 3, 0.0, 1)}, st AS (SELECT src AS u, dst AS v FROM edges), reach(u, v) AS (SELECT u, u FROM st UNION SELECT r.u, st.v FROM reach r JOIN st ON r.v = st.u)
    SELECT u AS node, min(v) AS component FROM reach GROUP BY u""")
def graph_components(t: Tables):
    edges, parts = graph.stored(graph.co_citation(citing(t), "doc", "item", 3))
    return graph.components(edges, "src", "dst", parts=parts)


@query(f"""WITH RECURSIVE {PARTS}, {REG}, cited AS (SELECT l_orderkey AS doc, l_partkey AS item, min(l_linenumber) AS place FROM lineitem GROUP BY ALL),
    strong AS (SELECT src, dst, confidence, co, status <> 'Current' AS dead FROM edges JOIN reg ON pk = dst WHERE confidence >= 0.08 AND co >= 2),
    near AS (SELECT doc, item, place, dst, confidence, co, dead, row_number() OVER (PARTITION BY doc, item ORDER BY confidence DESC, co DESC, dst, src) AS r FROM cited JOIN strong ON src = item OR src = item - item % 2),
    fit AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place, item, r) AS step FROM near WHERE r <= 12 AND NOT dead AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc = near.doc AND c.item // 2 = near.dst // 2)),
    fold AS (SELECT doc, 0::BIGINT AS step, NULL::BIGINT AS item, 0 AS kept, []::STRUCT(key BIGINT, dst BIGINT, item BIGINT, confidence DOUBLE, co BIGINT)[] AS found FROM fit WHERE step = 1
        UNION ALL SELECT doc, step, item, CASE WHEN take THEN kept + 1 ELSE kept END, CASE WHEN take THEN list_append(list_filter(found, lambda f: f.key <> dst // 2), {{'key': dst // 2, 'dst': dst, 'item': item, 'confidence': confidence, 'co': co}}) ELSE found END
        FROM (SELECT *, kept < 3 AND len(list_filter(found, lambda f: f.key = dst // 2 AND f.confidence >= confidence)) = 0 AS take
              FROM (SELECT f.doc, f.step, f.item, f.dst, f.confidence, f.co, CASE WHEN s.item = f.item THEN s.kept ELSE 0 END AS kept, s.found FROM fold s JOIN fit f ON f.doc = s.doc AND f.step = s.step + 1))),
    last AS (SELECT doc, unnest(found, recursive := true) FROM fold QUALIFY row_number() OVER (PARTITION BY doc ORDER BY step DESC) = 1)
    SELECT doc, 'missing_connected' AS kind, 'medium' AS severity, dst::VARCHAR AS item, item::VARCHAR AS subject, co AS n FROM last QUALIFY row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, co DESC, dst) <= 8""")
def missing_connected(t: Tables):
    """Two parts that follow each other share a key, and the even one is the base of both."""
    edges = graph.co_citation(citing(t), "doc", "item", 2, 0.08, places=6).join(t.register.select(F.col("pk").alias("dst"), F.col("status").alias("dst_status")), "dst")
    cited = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("item"))
    key = lambda c: F.floor(F.col(c) / 2)
    return audit.missing_connected(cited.withColumn("base", F.col("item") - F.col("item") % 2).withColumn("key", key("item")), edges.withColumn("dst_key", key("dst")), 0.08, 2)


@query(f"""WITH {PARTS}, {UNDIRECTED}, v AS (SELECT 'endpoints' AS check_name, count(*) AS violations FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_size < 50)
    UNION ALL SELECT 'thresholds', count(*) FILTER (co < 3 OR confidence < 0.01 OR n_src < 5) FROM edges UNION ALL SELECT 'pairs', count(*) FILTER (a >= b) FROM und) SELECT check_name, violations, violations = 0 AS passed FROM v""")
def graph_invariants(t: Tables):
    """The graph of parts against a part of the register, and against thresholds that it was not built with."""
    e, parts = stored_part_edges(t)
    held = t.part.filter("p_size < 50").select(F.col("p_partkey").alias("node"))
    return checks.report({"endpoints": checks.endpoints_known(e, held, "node", parts), "thresholds": checks.thresholds_hold(e, 3, 0.01, 5), "pairs": graph.undirected(e, parts).filter("a >= b")})


@query(f"""WITH {PARTS}, {REG}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
    f AS (SELECT family, sum(degree) AS n FROM d JOIN reg ON pk = node GROUP BY 1) SELECT family, CAST(n AS BIGINT) AS n, round(100.0 * n / max(n) OVER (), 1) AS bar, round(100.0 * n / sum(n) OVER (), 2) AS share FROM f""")
def graph_family_shares(t: Tables):
    edges, parts = stored_part_edges(t)
    d = graph.degrees(edges, parts=parts).join(over_tasks(t.register.select(F.col("pk").alias("node"), "family"), parts, "node"), "node")
    return bars(d.groupBy("family").agg(F.sum("degree").alias("n")), "n")


@query()
def graph_layout(t: Tables):
    edges, parts = graph.stored(supplier_edges(t))
    pairs = graph.edge_cap(graph.undirected(edges, parts), 12, parts)
    return graph.layout(pairs).select("node", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH {REG}, {BRIDGE}, m AS (SELECT pk AS item FROM reg WHERE family IN ('Brand#1', 'Brand#2')),
    marks AS (SELECT o_orderkey AS doc, o_orderstatus <> 'P' AS has_text, o_orderpriority = '1-URGENT' AS demands FROM orders),
    f AS (SELECT doc, 'dispute_risk' AS kind, 'high' AS severity, item::VARCHAR AS item, status AS subject FROM bridge JOIN reg ON pk = item WHERE status <> 'Current'
        UNION ALL SELECT b.doc, 'statutory_omission', CASE WHEN has_text THEN 'high' ELSE 'medium' END, b.item::VARCHAR, NULL FROM bridge b JOIN m USING (item) JOIN marks USING (doc) WHERE NOT has_text OR NOT demands
        UNION ALL SELECT doc, 'not_in_register', 'low', (item + 1000000)::VARCHAR, NULL FROM bridge WHERE item % 97 = 0)
    SELECT doc, kind, severity, item, subject, row_number() OVER (PARTITION BY doc ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, kind, item, subject NULLS FIRST) AS place FROM f""")
def audit_findings(t: Tables):
    return _findings(t).drop("n")


def _findings(t: Tables):
    resolved = t.bridge.join(t.register.select(F.col("pk").alias("item"), "status", "family"), "item")
    mandatory = t.register.filter(F.col("family").isin("Brand#1", "Brand#2")).select(F.col("pk").alias("item"))
    marks = t.orders.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderstatus") != "P").alias("has_text"), (F.col("o_orderpriority") == "1-URGENT").alias("demands"))
    unknown = t.bridge.filter("item % 97 = 0").select("doc", (F.col("item") + 1000000).alias("item"))
    return audit.assembled([audit.dispute_risk(resolved), audit.statutory_omission(resolved, mandatory, marks), audit.not_in_register(unknown)])


@query(f"""WITH {REG}, {BRIDGE}, m AS (SELECT pk AS item FROM reg WHERE family IN ('Brand#1', 'Brand#2')),
    marks AS (SELECT o_orderkey AS doc, o_orderstatus <> 'P' AS has_text, o_orderpriority = '1-URGENT' AS demands FROM orders),
    f AS (SELECT doc, 'high' AS severity FROM bridge JOIN reg ON pk = item WHERE status <> 'Current'
        UNION ALL SELECT b.doc, CASE WHEN has_text THEN 'high' ELSE 'medium' END FROM bridge b JOIN m USING (item) JOIN marks USING (doc) WHERE NOT has_text OR NOT demands
        UNION ALL SELECT doc, 'low' FROM bridge WHERE item % 97 = 0),
    c AS (SELECT doc, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS findings FROM f GROUP BY 1)
    SELECT o_orderkey AS doc, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(findings, 0) AS findings,
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'unreadable' WHEN high > 0 THEN 'blocking' WHEN findings > 0 THEN 'review' ELSE 'clean' END AS verdict FROM orders LEFT JOIN c ON doc = o_orderkey""")
def audit_verdicts(t: Tables):
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).alias("scan"))
    return audit.counts(docs, _findings(t), F.col("scan")).drop("scan")
