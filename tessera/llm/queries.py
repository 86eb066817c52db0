"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, language, media, mixing, packing, quality, runs, simhash, token_counts, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a scan of fewer splits than cores (files of one row group) is dealt over the cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if name not in ("documents", "pages") or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_bytes")


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text has this remainder; ids of null are in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~in_fold("doc_id", 5, 0)))
    return language.identify(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "languages")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), token_counts.revision(F.col("text")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~in_fold("doc_id", 4, 2)))
    scored = toxicity.scores(docs, model, ["doc_id"])
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's operator where components decide: each page whose page_id is a multiple of 3 redirects to the page of a third of it."""
    pages = table(spark, sf_dir, "pages")
    to = pages.select((F.col("page_id") * 3).alias("page_id"), F.col("url").alias("to_url"))
    links = pages.select("page_id", F.col("url").alias("from_url")).join(to, "page_id")
    return url_filter.verdicts(pages, url_filter.rule_table(spark, ALIAS_RULES), links)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"), longest=5, least=100, covered=100, top=2000)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("distance")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", runs.with_period("doc_id", "text"))
    return runs.digests(runs.periodic_runs(docs))


#: Rules of alias_verdicts.
ALIAS_RULES = [("com/en/", "block"), ("net/", "allow"), ("org/es/", "block")]

QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_media_columns": op6_media_columns,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "alias_verdicts": alias_verdicts,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Targets of canonical links and refreshes of pages; relative ones by the page's folder (dot segments stay as they are).
_PAGE_LINKS = """SELECT src, CASE WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
            WHEN starts_with(x, '/') THEN scheme || '://' || h || x WHEN regexp_matches(x, '^[?#]') THEN scheme || '://' || h || p || x ELSE scheme || '://' || h || '/' || coalesce(regexp_extract(p, '(?s)^/(.*/)?', 1), '') || x END
        FROM (SELECT src, regexp_extract(src, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(src, '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(src, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p, regexp_replace(trim(CASE
            WHEN starts_with(lower(tag), '<link') AND list_contains(string_split_regex(lower(coalesce(rel.a, '') || coalesce(rel.b, '') || coalesce(rel.c, '')), '\\s+'), 'canonical') THEN coalesce(href.a, '') || coalesce(href.b, '') || coalesce(href.c, '')
            WHEN starts_with(lower(tag), '<meta') AND trim(lower(coalesce(equiv.a, '') || coalesce(equiv.b, '') || coalesce(equiv.c, ''))) = 'refresh' THEN regexp_extract(coalesce(content.a, '') || coalesce(content.b, '') || coalesce(content.c, ''), '(?i)\\burl\\s*=\\s*["'']?([^"'']+)', 1) END), '(?i)&(amp|#38|#x26);', '&', 'g') AS x
        FROM (SELECT src, tag, regexp_extract(tag, $p$(?is)[\\s"'/]rel\\s*=\\s*(?:"([^">]*)"|'([^'>]*)'|([^\\s"'>]+))$p$, ['a', 'b', 'c']) AS rel, regexp_extract(tag, $p$(?is)[\\s"'/]href\\s*=\\s*(?:"([^">]*)"|'([^'>]*)'|([^\\s"'>]+))$p$, ['a', 'b', 'c']) AS href,
            regexp_extract(tag, $p$(?is)[\\s"'/]http-equiv\\s*=\\s*(?:"([^">]*)"|'([^'>]*)'|([^\\s"'>]+))$p$, ['a', 'b', 'c']) AS equiv, regexp_extract(tag, $p$(?is)[\\s"'/]content\\s*=\\s*(?:"([^">]*)"|'([^'>]*)'|([^\\s"'>]+))$p$, ['a', 'b', 'c']) AS content
        FROM (SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(-->|$)', ' ', 'g'), '(?i)<(?:link|meta)\\b[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM pages))) WHERE x <> ''"""


def _verdict_sql(rules: list[tuple[str, str]], links: str) -> str:
    """Rules by host and path, then aliases: what a blocked url reaches over links is blocked unless its own rule allows it."""
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    rest = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN translate(regexp_extract({u}, '(?s)^(.*?)://', 1), '{UPPER}', '{LOWER}') || '://' || {host(u)} || CASE WHEN starts_with({rest(u)}, '/') THEN '' ELSE '/' END || {rest(u)} END"
    return f"""
        WITH RECURSIVE rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in rules)}),
        cut AS (SELECT rule, verdict, substr(rule, 1, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
        links(f, t) AS ({links}),
        edges AS (SELECT DISTINCT a, b FROM (SELECT {node('f')} AS a, {node('t')} AS b FROM links) WHERE a <> b),
        both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        urls AS (SELECT a AS url FROM both_ways UNION SELECT url FROM pages),
        parts AS (SELECT url, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM urls),
        best AS (SELECT url, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
                 FROM parts JOIN cut ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY url),
        bad(node) AS (SELECT node FROM parts JOIN best USING (url) WHERE verdict = 'block' AND node IN (SELECT a FROM both_ways) UNION SELECT b FROM bad JOIN both_ways ON a = bad.node)
        SELECT page_id, host, path, rule, CASE WHEN best.verdict IS NOT NULL THEN best.verdict WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM pages LEFT JOIN parts ON pages.url IS NOT DISTINCT FROM parts.url LEFT JOIN best ON best.url = pages.url"""


def _quality_sql() -> str:
    """Counts by the definition, then the concentration steps one after another."""
    axes = range(len(quality.X))
    cells = [(i, j) for i in axes for j in range(i + 1)]
    word = "[^\\x20\\x09-\\x0D]+"
    y = [f"(x{i}::DOUBLE - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}" for i in axes]
    distance = f"{', '.join(y)}, 0.0::DOUBLE + {' + '.join(f'y{i} * y{i}' for i in axes)} AS d"
    bin_of = f"least(floor(d * {quality.FINE}), {quality.BINS})"
    means = ", ".join(f"sum(x{i})::DOUBLE / count(*)::DOUBLE AS m{i}" for i in axes)
    sums = ", ".join(f"sum(x{j} * x{i})::DOUBLE / count(*)::DOUBLE AS c{i}{j}" for i, j in cells)
    under = lambda i, j: f"c{i}{j} - m{i} * m{j}{f' + {quality.FLOOR**2}.0::DOUBLE' if i == j else ''}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}"
    lower = ", ".join(f"sqrt(greatest({under(i, i)}, 1.0)) AS l{i}{i}" if i == j else f"({under(i, j)}) / l{j}{j} AS l{i}{j}" for i, j in cells)
    names = ", ".join([*(f"m{i}" for i in axes), *(f"l{i}{j}" for i, j in cells)])
    det = " * ".join(f"l{i}{i}" for i in axes)
    estimate = lambda near: f"SELECT g, n, start, {names}, {det} AS det FROM (SELECT *, {lower} FROM (SELECT g, n, start, {means}, {sums} FROM {near} GROUP BY g, n, start))"
    quartile = lambda i, q: f"min(CASE WHEN 4 * up{i} >= {q} * n THEN x{i} END)::DOUBLE"
    middle = ", ".join([*(f"{quartile(i, 2)} AS m{i}" for i in axes), *(f"greatest(({quartile(i, 3)} - {quartile(i, 1)}) / 1.349::DOUBLE, {quality.FLOOR}.0::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in cells)])
    steps = ""
    for k in range(quality.STEPS):
        steps += f"""
        placed{k} AS (SELECT *, {bin_of} AS bin FROM (SELECT *, {distance} FROM grouped JOIN e{k} USING (g, n))),
        radius{k} AS (SELECT g, start, min(bin) AS radius FROM (SELECT g, n, start, bin, sum(count(*)) OVER (PARTITION BY g, start ORDER BY bin) AS upto FROM placed{k} GROUP BY g, n, start, bin) WHERE upto >= n * {quality.QUARTERS} // 4 + 1 GROUP BY g, start),
        e{k + 1} AS ({estimate(f"(SELECT p.g, p.n, p.start, {', '.join(quality.X)} FROM placed{k} p JOIN radius{k} USING (g, start) WHERE bin <= radius)")}),"""
    return f"""
        WITH t AS (SELECT rowid AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
        windows AS (SELECT row, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}}), recursive := true) FROM t WHERE len(w) > 2),
        again AS (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY row, a, b, c) AS times FROM windows) WHERE times > 1),
        repeats AS (SELECT row, count(DISTINCT place) AS n_repeat_words FROM again GROUP BY row),
        base AS (SELECT row, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS n_dup_lines,
                        coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN repeats USING (row)),
        failing AS (SELECT *, n_words < {quality.WORDS} OR 100 * n_repeat_words > {quality.REPEATED} * n_words AS base_failed FROM base),
        passed AS (SELECT row, lang, source, floor({quality.UNIT} * ln(word_chars / n_words))::BIGINT AS x0, floor({quality.UNIT} * sqrt(n_symbols / word_chars))::BIGINT AS x1, floor({quality.UNIT} * sqrt(n_repeat_words / n_words))::BIGINT AS x2,
                          floor({quality.UNIT} * sqrt(n_dup_lines / n_words))::BIGINT AS x3, count(*) OVER (PARTITION BY lang, source) < {quality.LEAST} AS few FROM failing WHERE NOT base_failed),
        named AS (SELECT *, {{'lang': lang, 'source': CASE WHEN few THEN NULL ELSE source END, 'few': few}} AS g FROM passed),
        grouped AS (SELECT *, {', '.join(f'count(*) OVER (PARTITION BY g ORDER BY x{i}) AS up{i}' for i in axes)} FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM named) WHERE n >= {quality.LEAST}),
        e0 AS ({estimate('(SELECT *, 0 AS start FROM grouped)')} UNION ALL SELECT g, n, 1, {middle}, 0.0 FROM grouped GROUP BY g, n),{steps}
        best AS (SELECT * FROM e{quality.STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1),
        far AS (SELECT row, d / {quality.consistency(quality.QUARTERS / 4)!r}::DOUBLE >= {quality.CUTOFF} AS outlier FROM (SELECT *, {distance} FROM grouped JOIN best USING (g, n)))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outlier, false) AS kept FROM failing LEFT JOIN far USING (row)"""


SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op8_url_filter": _verdict_sql(url_filter.RULES, _PAGE_LINKS),
    "alias_verdicts": _verdict_sql(ALIAS_RULES, f"{_PAGE_LINKS} UNION ALL SELECT p.url, q.url FROM pages p JOIN pages q ON p.page_id = 3 * q.page_id"),
    # base 32 of the digest: each 5 hex digits are 4 letters
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC) AS place,
                          max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
        d AS (SELECT *, sha1(html) AS hex FROM p)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5) AS INTEGER) >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN top END AS refers_to
        FROM d""",
    "op11_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM words, range(1, 6) sizes(m)),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 100),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM candidates, range(1, 5) ks(k) WHERE k < m),
        scores AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
                   FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a AS f, array_to_string(w[i:j], ' ') AS phrase FROM candidates, range(1, 6) starts(i), range(1, 6) ends(j) WHERE i < j AND j <= m AND j - i + 1 < m) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE inside.f IS NULL OR 100 * inside.f < 100 * a QUALIFY rank <= 2000""",
    "op12_quality_rules": _quality_sql(),
    # runs by the definition: each pair of equal words of a text at each distance, in islands
    "op13_periodic_runs": """
        WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
        cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
        sized AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM cut),
        texts AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) AS w FROM sized),
        words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts WHERE n > 0),
        pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3),
        islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (SELECT * FROM islands x WHERE NOT EXISTS (SELECT 1 FROM islands o WHERE o.doc_id = x.doc_id AND o.q < x.q AND o.s <= x.s AND o.s + o.m >= x.s + x.m)),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
        told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                        list({'s': s, 'm': m, 'q': q} ORDER BY s, q) AS all_runs FROM runs GROUP BY doc_id),
        best AS (SELECT doc_id, n_runs, lines, list_reduce(all_runs, lambda b, r: CASE WHEN r.m * b.q > b.m * r.q THEN r ELSE b END) AS r FROM told)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.m AS length, r.q AS period, 1000 * r.m // r.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM sized LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
