"""Readable names for documents from their file names, with words that a vocabulary knows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import clean_null


def vocabulary(texts: list[tuple[DataFrame, str]], extra: list[str] = ()) -> DataFrame:
    """Distinct words of three letters at least in the columns named, words of procurement, and the extra ones."""
    extra = [*fixed.PROCUREMENT_WORDS, *extra]
    out = None
    for df, column in texts:
        words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
        out = words if out is None else out.unionByName(words)
    spark = out.sparkSession
    if extra:
        out = out.unionByName(spark.createDataFrame([(w,) for w in extra], "word string"))
    return out.distinct()


def pieces(name: Column) -> Column:
    """Words of a file name: extension, ids and times off, then cut at marks, at lower-to-upper case, and at digits."""
    t = F.regexp_replace(name, fixed.TITLE_SUFFIX, "")
    t = F.regexp_replace(t, fixed.TITLE_ID, " ")
    t = F.regexp_replace(F.regexp_replace(t, fixed.TITLE_DATE, " "), fixed.TITLE_STAMP, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[_\-.]+", " "), "(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def titled(docs: DataFrame, key: str, name: str, family: str, words: DataFrame) -> DataFrame:
    """key, title, derived: known words in order, cased; a generic title gets the family; without a word, nothing is made up.

    The vocabulary is joined by word, so that it may be as large as the register's titles make it.
    """
    low = F.lower("_w")
    names = F.create_map(*[F.lit(x) for kv in fixed.ABBREVIATIONS.items() for x in kv])
    tokens = docs.select(key, F.posexplode(pieces(F.col(name))).alias("_i", "_w")).withColumn("_l", low)
    known = tokens.join(words.select(F.col("word").alias("_l"), F.lit(True).alias("_v")), "_l", "left")
    kept = F.when(F.element_at(names, F.col("_l")).isNotNull(), F.element_at(names, F.col("_l"))).when(F.col("_w").rlike("^[0-9]{1,3}$"), F.concat(F.lit("#"), F.col("_w"))).when(F.col("_w").rlike("^[A-Za-z]{3,}$") & F.col("_v"), F.col("_w"))
    lists = known.withColumn("_k", kept).filter("_k is not null").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_k"))), lambda x: x["_k"]).alias("_ws"))
    # a number stays only behind a word that takes one
    numbered = F.filter("_ws", lambda w, i: ~w.startswith("#") | F.coalesce(F.lower(F.get(F.col("_ws"), i - 1)).isin(fixed.ORDINAL_OWNERS), F.lit(False)))
    plain = F.transform(numbered, lambda w: F.regexp_replace(w, "^#", ""))
    joined = F.array_join(plain, " ")
    small = "|".join(fixed.SMALL_WORDS)
    trimmed = F.regexp_replace(F.regexp_replace(joined, rf"(?i)^(?:(?:{small})\b\s*)+", ""), rf"(?i)(?:\s*\b(?:{small}))+$", "")
    cased = F.array_join(F.transform(F.split(trimmed, " "), lambda w, i: F.when(F.upper(w).isin(fixed.ALWAYS_UPPER), F.upper(w)).when((i > 0) & F.lower(w).isin(fixed.SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w)))))), " ")
    fam = F.when(F.lower(clean_null(F.col(family))) != "unclassified", clean_null(F.col(family)))
    out = docs.select(key, fam.alias("_f")).join(lists.withColumn("_t", cased).select(key, "_t"), key, "left")
    has = F.coalesce(F.col("_t").rlike("[A-Za-z]{3,}"), F.lit(False))  # ends are bare of marks
    out = out.withColumn("_t", F.regexp_replace("_t", "^[ –—,-]+|[ –—,-]+$", ""))
    named = F.when(F.lower("_t").isin(fixed.GENERIC_TITLES) & F.col("_f").isNotNull(), F.concat("_t", F.lit(" — "), "_f")).otherwise(F.col("_t"))
    bare = F.when(F.col("_f").isNotNull(), F.concat(F.lit("Untitled "), F.lower(F.substring("_f", 1, 1)), F.substring(F.col("_f"), F.lit(2), F.char_length("_f")), F.lit(" tender"))).otherwise("Untitled tender")
    return out.select(key, F.when(has, F.substring(named, 1, 90)).otherwise(bare).alias("title"), has.alias("derived"))


def ungrounded(register: DataFrame, title: str) -> DataFrame:
    """key, full of the expansions that the register's titles bear out neither whole nor by their first word, in one pass."""
    rules = [(k, v) for rules in (fixed.EXPANSIONS, fixed.STRICT_EXPANSIONS, fixed.PHRASES) for k, v in rules.items()]
    said = F.lower(F.col(title))
    head = lambda v: re.sub("[^a-z ]", "", v.lower()).split()[0]
    borne = [F.coalesce(F.max((F.contains(said, F.lit(v.lower())) | F.contains(said, F.lit(head(v)))).cast("int")), F.lit(0)).alias("b") for _, v in rules]
    one = register.agg(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("full"), b) for (k, v), b in zip(rules, borne)]).alias("r"))
    return one.select(F.inline("r")).filter("b = 0").select("key", "full")
