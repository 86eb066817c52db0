"""Queries: peers' repeats, checks by number, accepted repairs, further pipelines, evidence, summaries, loads and invariants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import citations, values, verdicts
from ..operators import audit, checks, desk, evaluate, graph, lookup, merge, repair, resolve, retrieve, rollup
from ..sources import html, sinks, tables
from .base import BRIDGE, BUYERS, KEY_DIGITS, REG, Tables, inside, inside_sql, query
from .desk import records
from .graphs import PARTS, UNDIRECTED, part_edges, stored_part_edges
from .lookups import DEAD_BASES, FLAGGED, flagged
from .retrieval import BM25, ranked


def _folder(t: Tables, label: str) -> str:
    return f"{graph.settled_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


# --- peers, numbers, repairs ---------------------------------------------------------------------------------------


@query(f"""WITH {BM25}, {REG}, {BRIDGE}, {DEAD_BASES}, {FLAGGED}, {BUYERS}, top AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM bm WHERE rank <= 30 AND score > 0),
    near AS (SELECT *, count(*) OVER (PARTITION BY query) AS c FROM top WHERE score >= 0.35 * best),
    bad AS (SELECT doc, (list(item ORDER BY item))[1:6] AS dead FROM (SELECT DISTINCT doc, item FROM flagged WHERE dead) GROUP BY doc),
    j AS (SELECT near.query, near.doc, near.rank, b.c_mktsegment AS category, b.department AS buyer, bad.dead AS dead FROM near LEFT JOIN buyers b ON b.doc = near.doc LEFT JOIN bad ON bad.doc = near.doc WHERE c >= 3)
    SELECT query, count(*) AS peers, count(dead) AS repeating, coalesce(array_to_string((list(doc || ':' || array_to_string(dead, ',') ORDER BY len(dead) DESC, rank) FILTER (dead IS NOT NULL))[1:8], ' '), '') AS repeats,
        coalesce(array_to_string((list(category ORDER BY rank))[1:4], ', '), '') AS examples, coalesce(array_to_string((list_sort(list(DISTINCT buyer) FILTER (buyer IS NOT NULL)))[1:6], ', '), '') AS buyers FROM j GROUP BY query""")
def peer_repeats(t: Tables):
    dead = flagged(t).filter("dead").select("doc", "item").distinct()
    about = t.buyers.select("doc", F.col("c_mktsegment").alias("category"), F.col("department").alias("buyer"))
    r = rollup.peer_repeats(retrieve.peers(ranked(t, 30)), dead, about)
    said = F.array_join(F.transform("repeats", lambda x: F.concat(x["doc"].cast("string"), F.lit(":"), F.array_join(F.transform(x["dead"], lambda d: d.cast("string")), ","))), " ")
    return r.select("query", "peers", "repeating", said.alias("repeats"), F.array_join("examples", ", ").alias("examples"), F.array_join("buyers", ", ").alias("buyers"))


@query(f"""WITH {PARTS}, {REG}, nums AS (SELECT DISTINCT CASE WHEN item % 97 = 0 THEN item + 1000000 ELSE item END AS item FROM bridge),
    near AS (SELECT src AS item, string_agg(dst::VARCHAR, ' ' ORDER BY rank) AS related FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, co DESC, dst) AS rank FROM edges) WHERE rank <= 5 GROUP BY 1)
    SELECT item, status IS NOT NULL AS held, coalesce(status IN ('Superseded', 'Withdrawn'), false) AS dead, CASE WHEN status IN ('Superseded', 'Withdrawn') THEN CASE WHEN item % 2 = 0 THEN 'IS ' || (item + 1) ELSE 'UNKNOWN' END END AS replaced_by,
        p_type IS NOT NULL AS certified, p_type AS scheme, coalesce(related, '') AS related FROM nums LEFT JOIN reg ON pk = item LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'LARGE')) ON p_partkey = item LEFT JOIN near USING (item)""")
def number_checks(t: Tables):
    numbers = t.bridge.select(F.when(F.col("item") % 97 == 0, F.col("item") + 1000000).otherwise(F.col("item")).alias("item"))
    register = t.register.select(F.col("pk").alias("item"), "status", F.when(F.col("pk") % 2 == 0, F.concat(F.lit("IS "), (F.col("pk") + 1).cast("string"))).alias("replaced_by"))
    rules = t.part.filter(F.col("p_type").isin("PROMO", "LARGE")).select(F.col("p_partkey").alias("item"), F.col("p_type").alias("scheme"))
    near = lookup.top_per(part_edges(t), ["src"], [F.desc("confidence"), F.desc("co"), F.col("dst")], 5).select(F.col("src").alias("item"), "dst", "rank")
    out = audit.number_checks(numbers, register, rules, near)
    return out.withColumn("related", F.coalesce(F.array_join(F.transform("related", lambda x: x.cast("string")), " "), F.lit("")))


@query(f"""WITH {PARTS}, {UNDIRECTED}, u AS (SELECT doc, (item * 10)::VARCHAR AS item FROM bridge WHERE item % 97 = 0), k AS (SELECT p_partkey::VARCHAR AS s FROM part WHERE p_partkey >= 100),
    c AS (SELECT DISTINCT u.item AS unknown, k.s AS known FROM (SELECT DISTINCT item FROM u WHERE length(item) >= 3) u JOIN k ON abs(length(u.item) - length(k.s)) <= 1 AND damerau_levenshtein(u.item, k.s) = 1),
    beside AS (SELECT DISTINCT u.item AS unknown, b.item::VARCHAR AS beside FROM u JOIN bridge b USING (doc)), ways AS (SELECT a::VARCHAR AS x, b::VARCHAR AS y, co FROM und UNION ALL SELECT b::VARCHAR, a::VARCHAR, co FROM und),
    s AS (SELECT unknown, known, sum(co) AS n FROM c JOIN beside USING (unknown) JOIN ways ON x = known AND y = beside GROUP BY ALL), best AS (SELECT unknown, known FROM (SELECT *, row_number() OVER (PARTITION BY unknown ORDER BY n DESC, known::BIGINT) AS r FROM s) WHERE r = 1)
    SELECT doc, 'not_in_register' AS kind, 'low' AS severity, item, known AS subject FROM u LEFT JOIN best ON unknown = item""")
def findings_with_suggestions(t: Tables):
    unknown = t.bridge.filter("item % 97 = 0").select("doc", (F.col("item") * 10).cast("string").alias("item"))
    known = t.part.select(F.col("p_partkey").cast("string").alias("s"))
    pairs = graph.undirected(*stored_part_edges(t)).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("co").alias("n"))
    c = resolve.typo_candidates(unknown, "item", known, "s")
    beside = unknown.select("doc", F.col("item").alias("unknown")).join(t.bridge.select("doc", F.col("item").cast("string").alias("beside")), "doc").select("unknown", "beside")
    return audit.not_in_register(unknown, resolve.typo_choice(c, beside, pairs)).drop("n")


_REWRITE = f"""o AS ({inside_sql("'Use IS 10 (Part 1).'")}), w AS (SELECT doc_id, t, CASE doc_id % 4 WHEN 0 THEN t || ' As IS 77 says.' WHEN 1 THEN left(t, length(t) // 2) WHEN 2 THEN t || ' As IS 10 says.' ELSE ' ' || t END AS r FROM o)"""


def _rewrites(t: Tables):
    k = F.col("doc_id")
    docs = t.documents.select("doc_id", inside("Use IS 10 (Part 1).").alias("t"))
    half = F.substring(F.col("t"), F.lit(1), F.floor(F.char_length("t") / 2).cast("int"))
    return docs.withColumn("r", F.when(k % 4 == 0, F.concat("t", F.lit(" As IS 77 says."))).when(k % 4 == 1, half).when(k % 4 == 2, F.concat("t", F.lit(" As IS 10 says."))).otherwise(F.concat(F.lit(" "), F.col("t"))))


@query(rf"""WITH {_REWRITE}, f AS (SELECT doc_id, len(list_filter(regexp_extract_all(r, '(?:^|[^A-Za-z])IS[:\s]*(\d{{2,}})', 1), lambda n: n <> '10')) > 0 AS bad, length(trim(r, ' ')) < 0.55 * length(t) AS lost FROM w)
    SELECT doc_id, NOT bad AND NOT lost AS used, CASE WHEN bad THEN 'introduced_a_standard' WHEN lost THEN 'lost_content' END AS reason FROM f""")
def repair_acceptance(t: Tables):
    docs = _rewrites(t)
    return repair.accepted(docs, "doc_id", "t", "r", docs.select("doc_id", F.lit("IS 10").alias("cite")))


@query(rf"""WITH {_REWRITE}, {REG}, n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(r, '(?:^|[^A-Za-z])IS[:\s]*(\d{{2,}})', 1), lambda n: n::BIGINT)) AS cites FROM w),
    each AS (SELECT doc_id, unnest(cites) AS pk FROM n), f AS (SELECT doc_id, string_agg('IS ' || pk, ' ' ORDER BY 'IS ' || pk) FILTER (pk <> 10) AS intruders, count(*) FILTER (status <> 'Current') + count(*) FILTER (family IN ('Brand#1', 'Brand#2')) AS high FROM each LEFT JOIN reg USING (pk) GROUP BY doc_id)
    SELECT doc_id, coalesce(intruders, '') AS intruders, coalesce(high, 0) AS high, intruders IS NULL AND coalesce(high, 0) = 0 AS clean FROM w LEFT JOIN f USING (doc_id)""")
def repair_verified(t: Tables):
    """Rewrites, some of which name what they were not given, audited anew against the register."""
    docs = _rewrites(t)
    r = records(t)
    second = desk.audited(docs, "doc_id", "r", r).findings.filter("severity = 'high'")
    high = second.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("high"))
    out = repair.verified(docs, "doc_id", "r", docs.select("doc_id", F.lit("IS 10").alias("cite")), high, r.read)
    return out.withColumn("intruders", F.array_join("intruders", " "))


@query(rf"""WITH t AS ({inside_sql("'IS ' || (100 + doc_id % 40) || ' and IS 7098'")}), c AS (SELECT doc_id, 'IS ' || (100 + doc_id % 40) AS cite, CASE doc_id % 4 WHEN 0 THEN 'Withdrawn' WHEN 1 THEN 'Superseded' WHEN 2 THEN 'Current' ELSE 'unresolved' END AS status FROM documents
        UNION ALL SELECT doc_id, 'IS 7098', 'Current' FROM documents UNION ALL SELECT doc_id, 'IS 456', 'Current' FROM documents WHERE doc_id % 2 = 0),
    h AS (SELECT c.*, regexp_matches(t.t, '(?i)(^|[^A-Za-z])IS[:\s]*' || substr(cite, 4) || '([^\d]|$)') AS hit FROM c JOIN t USING (doc_id))
    SELECT doc_id, count(*) FILTER (hit AND status = 'Withdrawn') AS withdrawn, count(*) FILTER (hit AND status = 'Superseded') AS superseded, count(*) FILTER (hit AND status = 'Current') AS current, count(*) FILTER (hit AND status = 'unresolved') AS unresolved,
        coalesce(string_agg(cite, ', ' ORDER BY cite) FILTER (NOT hit), '') AS missing FROM h GROUP BY 1""")
def marked_text(t: Tables):
    k = F.col("doc_id")
    number = F.concat(F.lit("IS "), (k % 40 + 100).cast("string"))
    docs = t.documents.select("doc_id", inside(F.concat(number, F.lit(" and IS 7098"))).alias("t"))
    one = t.documents.select("doc_id", number.alias("cite"), F.when(k % 4 == 0, "Withdrawn").when(k % 4 == 1, "Superseded").when(k % 4 == 2, "Current").alias("status"))
    two = t.documents.select("doc_id", F.lit("IS 7098").alias("cite"), F.lit("Current").alias("status"))
    cites = one.unionByName(two).unionByName(two.filter("doc_id % 2 = 0").withColumn("cite", F.lit("IS 456")))
    return citations.marked(docs, "doc_id", "t", cites).withColumn("missing", F.array_join("missing", ", "))


# --- pipelines -----------------------------------------------------------------------------------------------------

#: Vectors whose ids are those of the benchmark's questions ask; all vectors answer.
ASKED = """d AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)), dn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM d)"""


def asked(t: Tables):
    queries = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieve.nearest(queries, "vec_id", t.embeddings, "vec_id", "embedding")


def _fused_sql(votes: str, n: int) -> str:
    return f"""f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM ({votes}) GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) AS rank FROM f)
    SELECT query, doc, rank, round(1 / (1 + exp(-12 * (least(rrf / ({n}.0 / 61), 1.0) - 0.55))), 4) AS score FROM s WHERE rank <= 10"""


BOTH = "SELECT query, doc, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM dn WHERE rank <= 20"


@query(f"WITH {BM25}, {ASKED}, {_fused_sql(BOTH, 2)}")
def search_pipeline_hybrid(t: Tables):
    return retrieve.search(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", "hybrid_rrf", asked(t)).select("query", "doc", "rank", "score")


@query(f"""WITH {BM25}, {ASKED}, {PARTS}, f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM ({BOTH}) GROUP BY ALL), short AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) AS rank FROM f QUALIFY rank <= 10),
    strong AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY co DESC, dst) AS r FROM edges),
    near AS (SELECT query, dst AS doc, min((rank, r)) AS o FROM short JOIN strong ON doc = src WHERE rank <= 3 AND r <= 5 GROUP BY ALL), fresh AS (SELECT near.* FROM near ANTI JOIN short USING (query, doc)),
    wide AS (SELECT query, doc, rrf, rank FROM short UNION ALL SELECT query, doc, 0.0, (SELECT max(rank) FROM short s WHERE s.query = fresh.query) + row_number() OVER (PARTITION BY query ORDER BY o, doc) FROM fresh)
    SELECT query, doc, rank, round(1 / (1 + exp(-12 * (least(rrf / (2.0 / 61), 1.0) - 0.55))), 4) AS score FROM wide""")
def search_graph_expand(t: Tables):
    """The fused shortlist with neighbours of its top, by the graph of parts over the same numbers."""
    return retrieve.search(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", "graph_expand", asked(t), edges=part_edges(t)).select("query", "doc", "rank", "score")


@query(f"WITH {BM25}, {ASKED}, by_id AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM dn WHERE rank <= 20), {_fused_sql(BOTH + ' UNION ALL SELECT query, doc, rank FROM by_id', 3)}")
def search_three_rankings(t: Tables):
    from pyspark.sql import Window

    dense = asked(t)
    third = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).select("query", "doc", "rank")
    return retrieve.search(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", "hybrid_rrf", dense, more=[third]).select("query", "doc", "rank", "score")


@query(f"WITH {ASKED} SELECT query, doc, rank, round(1 / (1 + exp(-12 * (score - 0.81))), 4) AS score FROM dn WHERE rank <= 10")
def search_pipeline_dense(t: Tables):
    return retrieve.search(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", "dense", asked(t)).select("query", "doc", "rank", "score")


@query(f"""WITH {ASKED}, m AS (SELECT query, string_agg(doc || ':' || format('{{:.4f}}', round(score, 4)), ' ' ORDER BY rank) FILTER (rank <= 5) AS matches, max(round(score, 4)) FILTER (rank = 1) AS top FROM dn GROUP BY 1)
    SELECT query, matches, CASE WHEN top >= 0.65 THEN 'High' WHEN top >= 0.40 THEN 'Medium' ELSE 'Low' END AS confidence, top < 0.40 AS routed FROM m""")
def dense_band(t: Tables):
    m = retrieve.matched(asked(t))
    said = F.array_join(F.transform("matches", lambda x: F.concat(x["doc"].cast("string"), F.lit(":"), F.format_string("%.4f", x["score"]))), " ")
    return m.select("query", said.alias("matches"), "confidence", "routed")


@query(f"""WITH {PARTS}, {REG}, e AS (SELECT CASE WHEN src % 2 = 0 THEN 'IS ' || src ELSE 'IS  ' || src END AS src, dst, confidence, src % 2 = 0 AS near, src AS n FROM edges)
    SELECT number AS source, dst, confidence, rank FROM (SELECT number, dst, confidence, row_number() OVER (PARTITION BY number ORDER BY confidence DESC, dst) AS rank FROM reg JOIN e ON n = pk) WHERE rank <= 5""")
def related_or_by_digits(t: Tables):
    """Every second designation of the graph is spelled in a way that only its digits match."""
    e = part_edges(t).select(F.concat(F.when(F.col("src") % 2 == 0, "IS ").otherwise("IS  "), F.col("src").cast("string")).alias("src"), "dst", "confidence")
    return graph.related_or_by_digits(t.register, "number", e, 5, KEY_DIGITS)


# --- populations, samples, summaries -------------------------------------------------------------------------------

_READ = """d AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'Usable' WHEN 'O' THEN 'Read by OCR' ELSE 'Scan' END AS usability, CASE WHEN o_orderkey % 5 = 0 THEN ' nan ' WHEN o_orderkey % 7 = 0 THEN '' ELSE 'IS 1' END AS cited,
    CASE WHEN o_orderkey % 3 = 0 THEN 'portal sweep 1' WHEN o_orderkey % 3 = 1 THEN 'by hand' END AS provenance FROM orders)"""


def _read(t: Tables):
    k = F.col("o_orderkey")
    usability = F.when(F.col("o_orderstatus") == "F", "Usable").when(F.col("o_orderstatus") == "O", "Read by OCR").otherwise("Scan")
    return t.orders.select(k.alias("k"), usability.alias("usability"), F.when(k % 5 == 0, " nan ").when(k % 7 == 0, "").otherwise("IS 1").alias("cited"), F.when(k % 3 == 0, "portal sweep 1").when(k % 3 == 1, "by hand").alias("provenance"))


@query(f"""WITH {_READ}, c AS (SELECT *, lower(trim(cited)) NOT IN ('', 'nan') AS cites FROM d) SELECT k, usability IN ('Usable', 'Read by OCR') AND cites AS in_evidence, usability = 'Usable' AND cites AS in_text_layer FROM c WHERE provenance IS NULL OR provenance NOT LIKE 'portal%'""")
def evidence_population(t: Tables):
    from ..functions import fixed

    own = tables.not_from(_read(t), "provenance", "portal")
    return own.select("k", values.in_evidence(F.col("usability"), F.col("cited")).alias("in_evidence"), values.in_evidence(F.col("usability"), F.col("cited"), fixed.TEXT_LAYER).alias("in_text_layer"))


@query(f"WITH {REG} SELECT base, pk, status FROM (SELECT pk // 3 AS base, pk, status, row_number() OVER (PARTITION BY pk // 3 ORDER BY CASE WHEN status = 'Current' THEN 0 ELSE 1 END, pk) AS r FROM reg) WHERE r = 1")
def preferred_rows(t: Tables):
    base = F.floor(F.col("pk") / 3).cast("long")
    return resolve.prefer_current(t.register, base, "pk", "status").select(base.alias("base"), "pk", "status")


@query("SELECT o_orderkey AS k FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 200")
def hashed_sample(t: Tables):
    return lookup.hash_sample(t.orders.select(F.col("o_orderkey").alias("k")), "k", 200, 3)


@query("""SELECT 'rows' AS measure, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'distinct', 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'filled', 'note', count(*) FILTER (p_size % 3 <> 0) FROM part""")
def collection_summary(t: Tables):
    df = t.part.withColumn("note", F.when(F.col("p_size") % 3 == 0, "").otherwise("noted"))
    return lookup.summary(df, "p_type", ["p_brand"], ["note"])


@query(f"""WITH {REG}, p AS (SELECT pk, CASE WHEN pk % 7 = 0 THEN 'Withdrawn' ELSE status END AS s, CASE WHEN pk % 11 = 0 THEN year + 1 ELSE year END AS y FROM reg WHERE pk % 13 <> 0),
    c AS (SELECT r.status AS held, p.s AS portal, r.status <> p.s AS st FROM reg r JOIN p USING (pk) WHERE r.status <> p.s OR r.year <> p.y)
    SELECT count(*) AS amendments, count(*) FILTER (st) AS status_changes, count(*) FILTER (NOT st) AS year_changes, count(*) FILTER (st AND held = 'Current' AND portal = 'Withdrawn') AS current_to_withdrawn FROM c""")
def amendment_summary(t: Tables):
    portal = t.register.filter("pk % 13 != 0").select("number", F.when(F.col("pk") % 7 == 0, "Withdrawn").otherwise(F.col("status")).alias("status"), F.when(F.col("pk") % 11 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"))
    return merge.amendment_summary(merge.detected(t.register, portal, "number", "status", "year"))


@query(f"""WITH {BRIDGE}, m AS (SELECT DISTINCT p_partkey AS item, p_brand AS family FROM part WHERE p_type IN ('PROMO', 'LARGE'))
    SELECT family, count(DISTINCT doc) AS n FROM bridge JOIN m USING (item) JOIN orders ON o_orderkey = doc WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1 ORDER BY n DESC, family LIMIT 8""")
def certification_families(t: Tables):
    rules = t.part.filter(F.col("p_type").isin("PROMO", "LARGE")).select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("family"))
    b = t.bridge.join(t.orders.select(F.col("o_orderkey").alias("doc"), "o_orderpriority"), "doc")
    demands = F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").when(F.col("o_orderpriority") == "5-LOW", "No attachment read").otherwise("No")
    return rollup.gap_families(b, "doc", "item", rules, "family", demands, 8)


@query("""SELECT vec_id AS k, label = 1 AS truth, CASE WHEN vec_id % 9 <> 0 THEN vec_id % 2 = 1 END AS predicted FROM embeddings WHERE (label = 1) IS DISTINCT FROM CASE WHEN vec_id % 9 <> 0 THEN vec_id % 2 = 1 END""")
def verdict_mismatches(t: Tables):
    return evaluate.mismatches(t.embeddings.withColumn("k", F.col("vec_id")), "k", F.col("label") == 1, F.when(F.col("vec_id") % 9 != 0, F.col("vec_id") % 2 == 1))


@query("SELECT count(*) AS queries, count(*) FILTER (user_id % 7 = 0) AS abstained, count(*) FILTER (user_id % 7 = 0 AND event_type <> 'view') AS correct FROM events")
def abstention_measures(t: Tables):
    return evaluate.abstentions(t.events.select((F.col("user_id") % 7 == 0).alias("abstained"), (F.col("event_type") == "view").alias("found")))


@query("SELECT event_type AS pipeline, count(*) FILTER (user_id % 5 <> 0 AND user_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 30)) AS outside FROM events GROUP BY 1")
def answers_outside(t: Tables):
    answers = t.events.select(F.col("event_type").alias("pipeline"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).cast("long").alias("answer"))
    return evaluate.outside(answers, t.part.filter("p_size < 30"), "answer", "p_partkey")


# --- sources, loads, records ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT conv_id, 0 AS kind, turn AS place, text AS line FROM conversations WHERE role = 'user' AND trim(text, ' ') <> ''),
    c AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE role <> 'user'),
    r AS (SELECT conv_id, 1 AS kind, turn AS place, string_agg(trim(w, ' '), ' | ' ORDER BY i) AS line FROM c GROUP BY ALL HAVING max((trim(w, ' ') <> '')::INT) = 1)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY kind, place) AS text FROM (SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY 1""")
def document_text(t: Tables):
    """Questions as paragraphs, the words of answers as cells of a table row."""
    c = t.conversations
    cells = c.filter("role != 'user'").select("conv_id", F.col("turn").alias("row"), F.posexplode(F.split("text", " ")).alias("cell", "text"))
    return tables.document_text(c.filter("role = 'user'").select("conv_id", F.col("turn").alias("place"), "text"), cells, "conv_id")


@query("""SELECT 'IS ' || p_partkey || ' (Part 1)' AS number, p_name AS title, '19' || lpad((p_size % 90 + 10)::VARCHAR, 2, '0') AS year, CASE WHEN p_size % 7 = 0 THEN 'Withdrawn' WHEN p_size % 5 = 3 THEN 'Superseded' WHEN p_size % 5 = 4 THEN 'Withdrawn' ELSE 'Current' END AS status,
    CASE WHEN p_size % 4 < 3 THEN 'Family ' || (p_size % 4) ELSE 'Unassigned department' END AS family, 'IS ' || p_partkey AS base, CASE WHEN p_size % 2 = 0 THEN '2030-01-01' ELSE '' END AS review_due FROM part""")
def catalogue_rows(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size")
    records = t.part.select(F.concat(F.lit(" IS "), k.cast("string"), F.lit(" (Part 1) ")).alias("standardNumber"), F.concat(F.lit(" "), "p_name").alias("standardName"), F.concat(F.lit("19"), F.lpad((size % 90 + 10).cast("string"), 2, "0"), F.lit("-05-01")).alias("publishedOn"), F.when(size % 2 == 0, "2030-01-01T00:00:00").alias("validUpto"), (size % 5).alias("isStatus"), (size % 7 == 0).alias("withdrawStatus"), (size % 4).alias("departmentId"))
    families = t.part.select((size % 4).alias("departmentId")).distinct().filter("departmentId < 3").withColumn("family", F.concat(F.lit("Family "), F.col("departmentId").cast("string")))
    return tables.catalogue_rows(records, families)


@query("""WITH n AS (SELECT p_brand, p_partkey, p_name, p_partkey % 5 = 0 AS has, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(p_partkey::VARCHAR, 9, '0')) AS r FROM part)
    SELECT p_brand AS brand, 'IS ' || p_partkey AS entry, last_value(CASE WHEN has THEN 'S.O. ' || p_partkey || ' gazette' END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY r ROWS UNBOUNDED PRECEDING) AS notification FROM n""")
def html_notifications(t: Tables):
    """Every fifth row names its order; the rows below are under the same."""
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("<tr><td>IS "), k, F.lit("</td><td>"), F.col("p_name"), F.lit("</td><td>"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("S.O. "), k, F.lit(" gazette"))).otherwise(""), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lpad(k, 9, "0").alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    pages = t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("h"))
    return html.grouped_rows(html.table_rows(pages, "brand", "h"), "brand", r"^IS \d+$").select("brand", "entry", "notification")


@query("""SELECT 'part' AS name, count(*) AS first, count(*) FILTER (p_partkey % 10 <> 0) AS last, true AS refused FROM part""")
def guarded_load_state(t: Tables):
    """Two loads that count, and one that shrinks too far and leaves the state as it was."""
    folder = _folder(t, "load")
    load = lambda df: sinks.loaded(df, folder, "part")
    first = load(t.part)
    load(t.part.filter("p_partkey % 10 != 0"))
    try:
        load(t.part.filter("p_partkey % 2 = 0"))
        refused = False
    except ValueError:
        refused = True
    return t.spark.createDataFrame([("part", first, tables.previous(t.spark, folder, "part"), refused)], "name string, first long, last long, refused boolean")


@query("""SELECT 'artefact' AS record, count(*) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL SELECT 'runs', 2 UNION ALL SELECT 'runs applied', 1 UNION ALL SELECT 'decisions', 3 UNION ALL SELECT 'unattributed', 1""")
def records_kept(t: Tables):
    """An artefact, two run records and three decisions, written and read back; a rejection without a reason is refused."""
    folder = _folder(t, "records")
    sinks.artefact(lookup.count_by(t.orders, "o_orderpriority"), f"{folder}/artefact")
    for apply in (True, False):
        sinks.append_run(t.spark, f"{folder}/runs", {"started": "now", "apply": apply}, "started string, apply boolean")
    for verb, officer, reason in (("accepted", " ", None), ("rejected", "A", "not so"), ("escalated", "B", None), ("overridden", "C", " ")):
        try:
            sinks.decision(t.spark, f"{folder}/decisions", verb, officer, reason)
        except ValueError:
            continue
    runs = tables.json_lines(t.spark, f"{folder}/runs", "started string, apply boolean")
    decided = t.spark.read.parquet(f"{folder}/decisions")
    counts = {"artefact": t.spark.read.json(f"{folder}/artefact"), "runs": runs, "runs applied": runs.filter("apply"), "decisions": decided, "unattributed": decided.filter("officer = 'unattributed'")}
    return lookup.row_counts(counts).withColumnRenamed("table_name", "record")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id, event_type FROM events WHERE event_id % 3 <> 0")
def json_lines_with_nulls(t: Tables):
    """Lines whose first field is null count; broken ones and those that are no object don't."""
    folder = _folder(t, "jsonl")
    k = F.col("event_id")
    line = F.concat(F.lit('{"user_id": '), F.when(k % 2 == 0, F.col("user_id").cast("string")).otherwise("null"), F.lit(', "event_id": '), k.cast("string"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('"}'))
    t.events.select(F.when(k % 6 == 0, "[1, 2]").when(k % 3 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(folder)
    return tables.json_lines(t.spark, folder, "user_id long, event_id long, event_type string").select("event_id", "user_id", "event_type")


# --- invariants ----------------------------------------------------------------------------------------------------


@query(f"""WITH {PARTS}, v AS (SELECT 'accounted' AS check_name, count(*) AS violations FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'reproduced', count(*) FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'counts_agree', count(*) FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%2') UNION ALL SELECT 'answerable', count(*) FROM part WHERE p_brand = 'Brand#1'
    UNION ALL SELECT 'screens_agree', CASE WHEN (SELECT count(DISTINCT doc) FROM bridge) = (SELECT count(*) FROM orders) THEN 0 ELSE 1 END UNION ALL SELECT 'endpoints_known', 0 FROM (SELECT count(*) FROM edges)
    UNION ALL SELECT 'complete_notifications', count(*) FROM part WHERE p_partkey % 50 = 0)
    SELECT check_name, violations, violations = 0 AS passed FROM v""")
def consistency_report(t: Tables):
    """Invariants, some of them broken on purpose for some rows."""
    o = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    stored = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    brands = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    said = brands.withColumn("n", F.col("n") + F.col("p_brand").endswith("2").cast("int"))
    b = t.bridge
    # a reference that goes on where it is cut: the date's year has a fifth digit
    edges, parts = stored_part_edges(t)
    tail = F.when(F.col("p_partkey") % 50 == 0, "20031").otherwise("2003 and more")
    rules = t.part.select(F.concat(F.lit("Order, S.O. "), F.col("p_partkey").cast("string"), F.lit("(E) dated 17-02-"), tail).alias("reference"))
    return checks.report({
        "accounted": checks.accounted(o, [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")], "k", graph.tasks(t.spark, o.count(), graph.ROWS)),
        "reproduced": checks.reproduced(stored, stored.withColumn("v", F.col("v") + (F.col("k") % 10 == 0).cast("int")), "k", "v"),
        "counts_agree": checks.counts_agree(said, brands, "p_brand", "n"),
        "answerable": checks.answerable(t.part.select(F.col("p_brand").alias("expected")), t.part.filter("p_brand != 'Brand#1'").select("p_brand").distinct(), "expected", "p_brand"),
        "screens_agree": checks.screens_agree({"bridge": b.agg(F.count_distinct("doc").alias("n")), "flagged": flagged(t).repartition(t.parts, "doc").agg(F.count_distinct("doc").alias("n")), "orders": o.agg(F.count(F.lit(1)).alias("n"))}),
        "endpoints_known": checks.endpoints_known(edges, t.part.select(F.col("p_partkey").alias("node")), "node", parts),
        "complete_notifications": checks.complete_notifications(rules, "reference"),
    })
