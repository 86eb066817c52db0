"""Reading: CSV, Parquet, JSON lines, vectors, binary documents; guarded loads and resumable scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, ids
from ..functions.values import clean_null
from .storage import Store


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, quoted line breaks and, maybe, a byte order mark; columns by the schema."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that hold a JSON object, nulls or not in its fields; others are dropped, not fatal."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def truthy(value: Column) -> Column:
    """Whether a JSON value of any kind says yes: not null, false, zero or empty."""
    kind = F.schema_of_variant(value)
    as_ = lambda t: F.try_variant_get(value, "$", t)
    said = F.when(kind == "BOOLEAN", as_("boolean")).when(kind == "STRING", as_("string") != "").when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~F.to_json(value).isin("[]", "{}")).otherwise(as_("double") != 0)
    return F.coalesce(F.when(~F.is_variant_null(value), said), F.lit(False))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """started, apply, place, stage, changed, facts (all of the stage, a variant) of each stage that a log of JSON lines has.

    Lines may be broken, values of any kind, and stages of any shape: what isn't an object in a list of stages is passed over.
    """
    runs = spark.read.text(path).select(F.try_parse_json("value").alias("run")).filter(F.startswith(F.schema_of_variant("run"), F.lit("OBJECT")))
    got = lambda c, p, t: F.try_variant_get(c, p, t)
    runs = runs.select(got("run", "$.started", "string").alias("started"), truthy(got("run", "$.apply", "variant")).alias("apply"), got("run", "$.results", "variant").alias("results"))
    runs = runs.filter(F.startswith(F.schema_of_variant("results"), F.lit("ARRAY")))
    stages = spark.sql("SELECT started, apply, pos AS place, value AS facts FROM {runs}, LATERAL variant_explode(results)", runs=runs).filter(F.startswith(F.schema_of_variant("facts"), F.lit("OBJECT")))
    return stages.select("started", "apply", "place", got("facts", "$.stage", "string").alias("stage"), truthy(got("facts", "$.changed", "variant")).alias("changed"), "facts")


def guarded(new: DataFrame, before: int | None, allow_shrink: bool = False, shrink: float = fixed.SHRINK) -> DataFrame:
    """The table, unless it is empty or lost more than a share of its rows since the last load."""
    n = new.count()
    if n == 0:
        raise ValueError("refusing an empty table")
    if before and not allow_shrink and n < before * (1 - shrink):
        raise ValueError(f"refusing a table that shrank from {before} to {n} rows")
    return new


def previous(spark: SparkSession, path: str, name: str) -> int | None:
    """Rows of a store's table at its last load; None before the first."""
    return Store(spark, path).pointer().rows(name)


def with_digits(register: DataFrame, number: str = "number") -> DataFrame:
    """The load-time key: digits of the base, zeros kept."""
    return register.withColumn("digits", ids.digits(F.col(number)))


def vectors(spark: SparkSession, path: str, register: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of ids that the register holds, as arrays of floats."""
    v = spark.read.parquet(path)
    return v.select(key, F.col(vector).cast("array<float>").alias(vector)).join(register.select(key), key, "left_semi")


def blob(key: Column, title: Column, family: Column) -> Column:
    """The text that is indexed for a row."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" — "), F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(family, F.lit("")))


def vector_text(title: Column, family: Column) -> Column:
    """The text that vectors are made from: without the id."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(family, F.lit("")))


def document_text(paragraphs: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, text: a document's paragraphs (key, place, text) that aren't blank, then its table rows (key, row, cell, text)
    that aren't empty, their trimmed cells joined by bars."""
    p = paragraphs.filter(F.trim("text") != "").select(key, F.struct(F.lit(0).alias("kind"), F.col("place").alias("at"), F.col("text").alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.trim(F.coalesce("text", F.lit(""))).alias("t")))), lambda c: c["t"]), " | ")
    rows = cells.groupBy(key, "row").agg(joined.alias("line"), F.max((F.trim(F.coalesce("text", F.lit(""))) != "").cast("int")).alias("_any")).filter("_any = 1")
    r = rows.select(key, F.struct(F.lit(1).alias("kind"), F.col("row").alias("at"), F.col("line")).alias("x"))
    return p.unionByName(r).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def container(content: Column) -> Column:
    """What a binary document is, by its first bytes; null for what can't be read."""
    head = F.substring(content.cast("binary"), 1, 4)
    return F.when(head == F.lit(b"%PDF"), "pdf").when(head == F.lit(b"PK\x03\x04"), "docx")


def extracted(pages: DataFrame, doc: str, page: str, text: str, most_pages: int = 60, most_chars: int = 20_000, scanned_under: int = 200) -> DataFrame:
    """One row per document from its page texts: joined text, whole and clipped, and whether it is a scan."""
    p = pages.filter(F.col(page) < most_pages).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("whole"), F.count(F.lit(1)).alias("n_pages"))
    return p.select(doc, "whole", F.substring("whole", 1, most_chars).alias("text"), "n_pages", (F.char_length("whole") / F.col("n_pages") < scanned_under).alias("scanned"))


def confirmed(citations: DataFrame, cited: str, register: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """Citations read off images: those whose base is held, and the dropped rest. Never more than the register knows."""
    held = register.select(ids.base(F.col(number)).alias("_b")).distinct()
    c = citations.withColumn("_b", ids.base(F.col(cited)))
    return c.join(held, "_b", "left_semi").drop("_b"), c.join(held, "_b", "left_anti").drop("_b")


def catalogue(records: DataFrame, status_id: str, withdrawn: str) -> DataFrame:
    """Portal records with a status from its number; a withdrawal overrides it."""
    names = F.create_map(*[F.lit(x) for kv in fixed.CATALOGUE_STATUS.items() for x in kv])
    return records.withColumn("status", F.when(F.coalesce(F.col(withdrawn), F.lit(False)), "Withdrawn").otherwise(F.element_at(names, F.col(status_id))))


def catalogue_rows(records: DataFrame, families: DataFrame) -> DataFrame:
    """Portal records (standardNumber, standardName, publishedOn, validUpto, isStatus, withdrawStatus, departmentId) in the
    register's shape; families: departmentId, family. Nothing is inferred: an unknown status counts as current."""
    r = catalogue(records, "isStatus", "withdrawStatus").join(families, "departmentId", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    number = blank("standardNumber")
    return r.select(number.alias("number"), blank("standardName").alias("title"), F.substring(blank("publishedOn"), 1, 4).alias("year"), F.coalesce("status", F.lit("Current")).alias("status"), F.coalesce("family", F.lit("Unassigned department")).alias("family"), ids.base(number).alias("base"), F.substring(blank("validUpto"), 1, 10).alias("review_due"))


def not_from(register: DataFrame, provenance: str, prefix: str) -> DataFrame:
    """Rows that the register held on its own: no provenance, or one that doesn't start with the prefix."""
    return register.filter(F.col(provenance).isNull() | ~F.startswith(F.col(provenance), F.lit(prefix)))


def search_words(register: DataFrame, title: str, family: str, number: str, least: int = 4) -> DataFrame:
    """Words to ask a portal with: title words by count, then family pieces, then designations; each once, blind to case."""
    words = register.select(F.explode(F.regexp_extract_all(F.lower(F.col(title)), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word")).filter(~F.col("word").isin(fixed.VOCABULARY_STOPS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pieces = register.select(F.explode(F.split(F.col(family), r"[^A-Za-z]+")).alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.lit(0).cast("long").alias("n"))
    marks = register.select(ids.base(F.col(number)).alias("word")).distinct().select("word", F.lit(-1).cast("long").alias("n"))
    both = words.unionByName(pieces).unionByName(marks).withColumn("_k", F.lower("word"))
    best = both.groupBy("_k").agg(F.max_by(F.struct("word", "n"), F.struct("n", "word")).alias("b"))
    return best.select("b.word", "b.n").orderBy(F.desc("n"), "word")


def unseen(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key no earlier run has written: how a scan is resumed."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def sampled_ids(spark: SparkSession, low: int, high: int, n: int, seed: int, done: DataFrame) -> DataFrame:
    """n ids of a range in the order of a digest, without those done."""
    return spark.range(low, high).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n).join(done, "id", "left_anti")


def inventory(files: DataFrame, path: str, prefix: str, skip: str) -> DataFrame:
    """Files by the id in their name, without those that end in ``skip``: one listing, no look-ups."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    f = files.select(F.regexp_extract(name, prefix, 1).alias("id"), name.alias("name")).filter((F.col("id") != "") & ~F.col("name").endswith(skip))
    return f.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("files"))


def reread(docs: DataFrame, scanned: Column, citations: Column) -> DataFrame:
    """What a second reading found: documents, scans, and distinct citations; a report, never merged."""
    d = docs.select(scanned.alias("_s"), F.explode_outer(citations).alias("_c"), F.monotonically_increasing_id().alias("_id"))
    return d.agg(F.count_distinct("_id").alias("documents"), F.count_distinct(F.when(F.col("_s"), F.col("_id"))).alias("scanned"), F.count_distinct("_c").alias("citations"))


def golden(df: DataFrame, expected: str) -> DataFrame:
    return df.filter(clean_null(F.col(expected)).isNotNull())


def golden_built(candidates: DataFrame, query: str, expected: str, title: str, register: DataFrame, key: str, least: int = 22, head: int = 40) -> DataFrame:
    """Queries from an outside text: long enough, with a held answer, not the answer's own title; each once, blind to case."""
    c = candidates.filter(F.char_length(query) >= least).join(register.select(F.col(key).alias(expected)), expected, "left_semi")
    c = c.filter(F.lower(F.substring(query, 1, head)) != F.lower(F.substring(title, 1, head)))
    return c.groupBy(F.lower(query).alias("_k")).agg(F.min_by(F.struct(*c.columns), F.struct(query, expected)).alias("r")).select("r.*")
