"""URL verdicts by host and path rules, spread over redirect equivalence.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule decides. Urls that no rule
fits take the verdict of their aliases: redirect and canonical-link edges between whole urls (scheme and host in lower
case, without fragment, a bare host with the path ``/``) are joined to components, and a component with a blocked url is
blocked. An allow rule of a url's own always stands, and shields the url from its aliases. Everything is DataFrame and
SQL functions.

Defined results: null urls, and urls without ``://``, have an empty host and path, fit no rule, have no aliases and are
allowed. Rows are judged one by one; repeated page_ids and urls keep their rows. Null or empty html has no edges. Targets
are resolved against the page's own url (``<base>`` is not read). An empty table gives an empty result; without rules all
is allowed. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import BROADCAST_BYTES, skew_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which they are part of the plan itself; more are joined by host.
INLINE = 1000
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first :// and the next slash, question mark or number sign, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark or number sign; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, verdict, and the rule's host and path."""
    df = spark.createDataFrame(rules or [("", "")], "rule string, verdict string").filter(F.lit(bool(rules)))
    return parted(df)


def parted(rules: DataFrame) -> DataFrame:
    cut = F.locate("/", F.col("rule"))
    host = F.when(cut == 0, F.col("rule")).otherwise(F.expr("left(rule, locate('/', rule) - 1)"))
    path = F.when(cut == 0, F.lit("")).otherwise(F.expr("substring(rule, locate('/', rule))"))
    return rules.select("rule", "verdict", lowered(host).alias("rule_host"), path.alias("rule_path"))


def _suffixes(host: Column) -> Column:
    """The host and each domain above it."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def matched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes (host, path and others; distinct above INLINE rules) with rule and own verdict, null where no rule fits. Longest first, then by text."""
    n = rules.count()
    best = F.struct(F.length("rule"), "rule", F.col("verdict"))
    if n <= INLINE:  # bounded: the rules are literals of a filter on each row
        listed = rules.select(best.alias("b"), "rule_host", "rule_path").collect()
        if not listed:
            return nodes.withColumns({"rule": F.lit(None).cast("string"), "own": F.lit(None).cast("string")})
        literal = F.array(*[F.struct(F.lit(int(r.b[0])).alias("n"), F.lit(r.b[1]).alias("rule"), F.lit(r.b[2]).alias("verdict"), F.lit(r.rule_host).alias("h"), F.lit(r.rule_path).alias("p")) for r in listed])
        dotted = F.concat(F.lit("."), F.col("host"))
        fits = F.filter(literal, lambda r: F.endswith(dotted, F.concat(F.lit("."), r["h"])) & F.startswith(F.col("path"), r["p"]))
        return nodes.withColumn("_best", F.array_max(fits)).withColumns({"rule": F.col("_best.rule"), "own": F.col("_best.verdict")}).drop("_best")
    # the prefixes of a url that may be a rule: each of its domains with each length that rule paths have (some hundred
    # at most); a key has one rule, and keys of many urls are dealt over many tasks
    lengths = F.array(*[F.lit(r.n) for r in rules.select(F.char_length("rule_path").alias("n")).distinct().collect()])
    per_key = rules.groupBy("rule_host", "rule_path").agg(F.max(best).alias("_best"))
    heads = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = nodes.select("host", "path", F.explode(F.array_distinct(_suffixes(F.col("host")))).alias("rule_host")).select("*", F.explode(heads).alias("rule_path"))
    if n * 200 <= BROADCAST_BYTES:
        hits = wide.join(F.broadcast(per_key), ["rule_host", "rule_path"])
    else:
        wide = written(wide.join(per_key.select("rule_host", "rule_path"), ["rule_host", "rule_path"], "left_semi"), "url-hits")
        sizes = wide.groupBy("rule_host", "rule_path").agg(F.count(F.lit(1)).alias("_m"))
        hits = skew_join(wide, per_key.join(sizes, ["rule_host", "rule_path"]), ["rule_host", "rule_path"], "_m", wide.count(), F.struct("host", "path"), "inner")
    found = hits.groupBy("host", "path").agg(F.max("_best").alias("_best"))
    return nodes.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "own": F.col("_best.verdict")}).drop("_best")


def undotted(path: Column) -> Column:
    """The path without its . and .. segments."""
    parts = F.split(path, "/", -1)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of this very name, empty if there is none."""
    value = lambda k: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))", k)
    return F.concat(value(1), value(2), value(3))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """from_url, to_url: canonical links and meta refresh redirects in a page's html; relative links are resolved against the page's url.

    rel is a list of words, any of which may be canonical; what stands in comments doesn't count, and a tag ends at its first >.
    """
    bare = F.regexp_replace(F.col(html), "(?s)<!--.*?(?:-->|$)", " ")
    tag = F.explode(F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"), F.lit(0)))
    tags = pages.filter(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("from_url"), tag.alias("tag"))
    kinds = F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+")
    canonical = F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(kinds, "canonical"), _attribute(F.col("tag"), "href"))
    content = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)\burl\s*=\s*[\"']?([^\"']+)", 1)
    refresh = F.when(F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh"), content)
    target = F.regexp_replace(F.trim(F.coalesce(canonical, refresh)), "(?i)&(?:amp|#38|#x26);", "&")
    scheme, host = F.regexp_extract("from_url", r"(?s)^(.*?)://", 1), host_of(F.col("from_url"))
    path = path_of(F.col("from_url"))
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?", 1))
    rooted = F.when(F.startswith(target, F.lit("/")), target).when(target.rlike("^[?#]"), F.concat(path, target)).otherwise(F.concat(folder, target))
    near = F.when(host != "", F.concat(scheme, F.lit("://"), host, undotted(F.regexp_extract(rooted, "^[^?#]*", 0)), F.regexp_extract(rooted, "[?#].*$", 0)))
    whole = F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target).when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target)).when(~target.rlike("(?i)^[a-z][a-z0-9+.-]*:") & (target != ""), near)
    return tags.select("from_url", whole.alias("to_url")).filter("to_url is not null and from_url is not null")


def node_of(url: Column) -> Column:
    """The whole url as a node: scheme and host in lower case, no fragment, at least the path /; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    whole = F.concat(lowered(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit("://"), host_of(url), F.when(F.startswith(rest, F.lit("/")), F.lit("")).otherwise(F.lit("/")), rest)
    return F.when(host_of(url) != "", whole)


def blocked_aliases(links: DataFrame, rules: DataFrame) -> DataFrame:
    """node: the urls of links (from_url, to_url) that are in a component with a blocked one; null if there are no links."""
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).filter("a != b").distinct()
    edges = written(edges, "url-edges")
    if edges.isEmpty():
        return None
    # urls of edges only: pages without aliases need no component
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    own = matched(nodes, rules) if rules.count() <= INLINE else nodes.join(matched(nodes.select("host", "path").distinct(), rules), ["host", "path"])
    own = written(own.filter("own = 'block'").select("node"), "url-own")
    joined = written(components(edges, "a", "b"), "url-components")
    blocked = joined.join(own, "node", "left_semi").select("component").distinct()
    groups = joined.groupBy("component").agg(F.count(F.lit(1)).alias("m")).join(blocked, "component")
    return written(skew_join(joined, groups, ["component"], "m", joined.count(), F.col("node"), "inner").select("node"), "url-blocked")


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; redirects adds from_url, to_url edges from elsewhere."""
    links = alias_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    # rows without a host go by themselves, so that they don't meet in one task
    node = F.coalesce(node_of(F.col(url)), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
    rows = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node.alias("node"))
    n = rules.count()
    if n <= INLINE:
        out = matched(rows, rules)
    else:
        rows = written(rows, "url-rows")
        sizes = rows.filter("host != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
        known = matched(written(sizes, "url-sizes"), rules)
        named = skew_join(rows.filter("host != ''"), known, ["host", "path"], "m", rows.count(), F.struct("page_id", "node"), "inner").drop("m")
        out = named.unionByName(rows.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "own": F.lit(None).cast("string")}))
    bad = blocked_aliases(links, rules)
    if bad is None:
        out = out.withColumn("_bad", F.lit(None).cast("boolean"))
    else:
        sizes = written(rows.join(bad, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("m")), "url-sizes")
        out = skew_join(out, sizes.withColumn("_bad", F.lit(True)), ["node"], "m", pages.count(), F.col("page_id"))
    verdict = F.coalesce("own", F.when(F.col("_bad"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
