"""Writing: tables with their counts, exports, artefacts, run records and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .storage import Store


def table(df: DataFrame, path: str, name: str = "table") -> int:
    """Replaces a table of a store and returns its number of rows, counted from what was written."""
    return Store(df.sparkSession, path).replace(name, df).rows(name)


def loaded(df: DataFrame, path: str, name: str, allow_shrink: bool = False) -> int:
    """A guarded load: refused if empty or shrunk since the last one; else table and count are replaced by one pointer."""
    from .tables import guarded, previous

    return table(guarded(df, previous(df.sparkSession, path, name), allow_shrink), path, name)


def export_csv(df: DataFrame, path: str, name: str, allowed: list[str], quote_all: bool = False) -> None:
    """A whole table as CSV with a header, if its name is on the list."""
    if name not in allowed:
        raise ValueError(f"{name} is not exported")
    df.write.mode("overwrite").options(header=True, quoteAll=quote_all, escape='"').csv(path)


def artefact(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_run(spark: SparkSession, path: str, record: dict, schema: str) -> None:
    spark.createDataFrame([record], schema).write.mode("append").json(path)


def decision(spark: SparkSession, path: str, decision_: str, officer: str = "", rationale: str | None = None, **more: str | None) -> None:
    """Appends a decision. Its verb must be known; rejecting and overriding take a reason; no name counts as unattributed."""
    if decision_ not in fixed.DECISIONS:
        raise ValueError(f"decision must be one of {', '.join(fixed.DECISIONS)}")
    if decision_ in ("rejected", "overridden") and not (rationale or "").strip():
        raise ValueError("a reason is needed")
    row = spark.createDataFrame([(officer.strip() or "unattributed", decision_, (rationale or "").strip() or None, more.get("document"), more.get("finding_kind"), more.get("number"), more.get("system_said"))], "officer string, decision string, rationale string, document string, finding_kind string, `number` string, system_said string")
    row.select(F.expr("uuid()").alias("id"), F.current_timestamp().alias("created_at"), "*").write.mode("append").parquet(path)


def html_report(rows: DataFrame, section: str, columns: list[str], order: list, most: int = 100) -> DataFrame:
    """section, html: a table for each section, of its first rows in an order that tells them apart, escaped, and how many
    more there are. A section holds ``most`` rows, whatever the input."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), esc(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    sizes = rows.groupBy(section).agg(F.count(F.lit(1)).alias("_n"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(section).orderBy(*order))).filter(F.col("_r") <= most)
    body = first.groupBy(section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("_body")).join(sizes, section)
    head = "".join(f"<th>{c}</th>" for c in columns)
    more = F.when(F.col("_n") > most, F.concat(F.lit("\n<p>and "), F.col("_n") - most, F.lit(" more</p>"))).otherwise("")
    return body.select(F.col(section).alias("section"), F.concat(F.lit("<h2>"), esc(F.col(section)), F.lit(f"</h2>\n<table><tr>{head}</tr>\n"), "_body", F.lit("\n</table>"), more).alias("html"))
