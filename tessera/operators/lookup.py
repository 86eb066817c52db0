"""Lists, facets, searches and bars over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clean_null

MOST = 500


def paged(df: DataFrame, equals: dict[str, object] | None = None, search: str | None = None, search_in: list[str] = (), sort: str | None = None, allowed_sorts: list[str] = (), key: str = "", limit: int = 100, offset: int = 0, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of the rows that pass all filters, in a total order, and a one-row frame with their number.

    Blank filters are ignored. A sort that isn't allowed is refused. The key breaks ties; limits stay in 1..MOST.
    """
    if sort and sort not in allowed_sorts:
        raise ValueError(f"cannot sort by {sort}")
    for column, value in (equals or {}).items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == F.lit(value))
    if search:
        df = df.filter(contains_any(search, search_in))
    order = [F.col(sort).desc() if descending else F.col(sort).asc()] if sort else []
    page = df.orderBy(*order, F.col(key).asc()).offset(max(0, offset)).limit(min(max(1, limit), MOST))
    return page, df.agg(F.count(F.lit(1)).alias("total"))


def contains_any(term: str, columns: list[str]) -> Column:
    """A plain substring in any of the columns, blind to case; wildcards have no meaning."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return out


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values without those that stand for none, sorted."""
    return df.select(clean_null(F.col(column)).alias("value")).filter("value is not null").distinct().orderBy("value")


def count_by(df: DataFrame, column: str, missing: str = "N/A") -> DataFrame:
    """Rows for each value, most first, then by value."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table; each count is an aggregate of its own scan, which reads no columns."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def typed_order(c: Column) -> list[Column]:
    """Numbers first, by value; then other text."""
    return [c.cast("string").try_cast("double").asc_nulls_last(), c.cast("string").asc()]


def places(df: DataFrame, order: list[Column], name: str = "place", tasks: int | None = None) -> DataFrame:
    """Adds the place of each row in a total order: ranges are sorted apart, and each starts behind the rows of those before.

    tasks: the number of ranges, in place of the session's."""
    from .graph import settled

    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    rows = settled((df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_at", at))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row for each range
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_at", "_start")


def bars(df: DataFrame, n: str, places: int = 1) -> DataFrame:
    """Adds bar (share of the largest) and share (of all) in percent. Meant for grouped rows: one window holds them all."""
    whole = Window.partitionBy()
    return df.withColumn("bar", F.round(100.0 * F.col(n) / F.max(n).over(whole), places)).withColumn("share", F.round(100.0 * F.col(n) / F.sum(n).over(whole), 2))


def summary(df: DataFrame, by: str, distinct: list[str] = (), filled: list[str] = ()) -> DataFrame:
    """measure, value, n: rows for each value of ``by``, distinct values of some columns, and rows in which others are filled."""
    per = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("N/A")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("measure"), "value", "n")
    whole = df.agg(*[F.count_distinct(c).alias(f"distinct:{c}") for c in distinct], *[F.count_if(F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))).alias(f"filled:{c}") for c in filled])
    rest = whole.select(F.explode(F.array(*[F.struct(F.lit(n.partition(":")[0]).alias("measure"), F.lit(n.partition(":")[2]).alias("value"), F.col(f"`{n}`").alias("n")) for n in whole.columns])).alias("x")).select("x.*")
    return per.unionByName(rest)


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order; partial top-k runs before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1, "_rank").drop("_rank")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a digest: the same rows on each run, and no sort of the whole table."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)
