"""Rows from HTML and forms: tables with headings carried down, sentences around designations, labelled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip_html
from ..functions.values import any_match


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cells of every table row."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?(?:</tr>|(?=<tr\b)|(?=</table>))"), F.lit(0))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|</tr>|</table>)"), F.lit(1)), strip_html)
    return rows.select(key, "table_no", "row_no", cells.alias("cells"))


def filled_down(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def grouped_rows(rows: DataFrame, key: str, is_key: str) -> DataFrame:
    """Data rows of tables: a row of one cell is a heading for those below it; the first cell that looks like a key names a row."""
    cells = F.filter("cells", lambda c: c != "")
    heading = F.when(F.size(cells) == 1, cells[0])
    notice = F.when(F.size(cells) > 1, F.get(F.filter(cells, lambda c: c.rlike(fixed.NOTICE)), 0))
    named = F.filter("cells", lambda c: c.rlike(is_key))
    r = filled_down(rows.withColumns({"heading": heading, "entry": F.get(named, 0), "notification": notice}), [key, "table_no"], ["row_no"], ["heading", "notification"])
    return r.filter((F.size(cells) > 1) & F.col("entry").isNotNull()).select(key, "table_no", "row_no", "heading", "entry", "notification", "cells")


def around(texts: DataFrame, key: str, text: str, pattern: str, words: list[str], width: int = 120) -> DataFrame:
    """entry, passage: the first passage around each match of the pattern that has one of the words."""
    hits = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{0,{width}}}?{pattern}.{{0,{width}}}"), F.lit(0))).alias("n", "passage"))
    hits = hits.withColumn("entry", F.regexp_extract("passage", f"({pattern})", 1)).filter(any_match(F.col("passage"), words))
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy("entry").orderBy(key, "n"))).filter("_r = 1").drop("_r")


def form_lines(text: Column) -> Column:
    """Lines of a form without glyph marks, white space collapsed."""
    return F.transform(F.split(F.regexp_replace(text, fixed.GLYPH_MARKS, " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def labelled(text: Column, label: str, most: int = 120) -> Column:
    """The value after a label, or on the next line if that isn't a label; empty if absent or blacked out."""
    lines = form_lines(text)
    hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].contains(label))
    first = F.get(hits, 0)
    trim = lambda c: F.regexp_replace(c, r"^[ :/,-]+|[ :/,-]+$", "")
    own = trim(F.substring_index(first["x"], label, -1))
    ahead = F.coalesce(F.get(lines, first["i"] + 1), F.lit(""))
    value = F.when(own != "", own).when(~ahead.rlike(fixed.LABEL_LINE), trim(ahead))
    return F.when(value.rlike(r"^[*\s]*$"), "").otherwise(F.coalesce(F.substring(value, 1, most), F.lit("")))


def category(text: Column, label: str = "Item Category", most: int = 140) -> Column:
    """A value that wraps around its label: up to two lines before, the label's own line, up to three after."""
    lines = form_lines(text)
    at = F.array_position(F.transform(lines, lambda x: x.contains(label)), True)
    stop = lambda x: (x == "") | x.rlike(fixed.LABEL_LINE)
    # a fold that stops at the first label line
    run = lambda a: F.aggregate(a, F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept")), lambda s, x: F.struct((s["done"] | stop(x)).alias("done"), F.when(s["done"] | stop(x), s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept")))["kept"]
    before = F.reverse(run(F.reverse(F.when(at > 1, F.slice(lines, F.greatest(F.lit(1), at - 2), F.least(F.lit(2), at - 1))).otherwise(F.array().cast("array<string>")))))
    own = F.trim(F.regexp_replace(F.regexp_replace(F.get(lines, at.cast("int") - 1), label, " "), r"^[\s/]+|[\s/]+$|\s*/\s*(?=\s)|(?<=\s)/\s*", " "))
    after = run(F.slice(lines, at + 1, F.lit(3)))
    joined = F.array_join(F.filter(F.concat(before, F.array(own), after), lambda x: x != ""), " ")
    joined = F.regexp_replace(joined, r"\bCustom(?:-|\s+Bid\s+for\s+Goods)?\s*", "")
    joined = F.regexp_replace(F.regexp_replace(joined, r"\s*Total\s+\d.*$", ""), r"\s*\(\(.*$", "")
    return F.when(at > 0, F.substring(F.regexp_replace(joined, r"^[ :/,-]+|[ :/,-]+$", ""), 1, most)).otherwise("")


def is_service(category_: Column) -> Column:
    return F.coalesce(category_.rlike(fixed.SERVICE), F.lit(False))


def wrapped(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Paragraphs from wrapped lines: a line goes on unless it is blank, a heading, or the last one ended a sentence."""
    from ..functions.text import is_heading

    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(line).over(w)
    starts = before.isNull() | (F.trim(before) == "") | F.trim(before).rlike(r"[.:;?!]$") | is_heading(F.col(line)) | is_heading(before)
    grouped = lines.withColumn("_s", starts.cast("int")).withColumn("paragraph", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.trim(line) != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: F.trim(x[line])), " ")
    return grouped.groupBy(by, "paragraph").agg(joined.alias("text"))
