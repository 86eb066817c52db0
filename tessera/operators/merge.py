"""Merging collected rows: additive, refreshing, and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .lookup import keep_first
from .plumbing import over_tasks


def additive(master: DataFrame, collected: DataFrame, key: str, broad=ids.base) -> DataFrame:
    """Collected rows of which neither the key nor the broad key is held; the first of each key."""
    held = master.select(broad(F.col(key)).alias("_b")).distinct()
    new = keep_first(collected, [key], [F.to_json(F.struct(*collected.columns)).asc()])
    return new.join(master.select(key).distinct(), key, "left_anti").withColumn("_b", broad(F.col(key))).join(held, "_b", "left_anti").drop("_b").select(*collected.columns)


def additive_two_keys(master: DataFrame, collected: DataFrame, first: str, second: str, order: Column) -> DataFrame:
    """Collected rows of which both keys are unseen, once for each value of either key in turn."""
    new = collected.join(master.select(first).distinct(), first, "left_anti").join(master.select(second).distinct(), second, "left_anti")
    return keep_first(keep_first(new, [first], [order]), [second], [order]).select(*collected.columns)


def refreshed(master: DataFrame, fresh: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """master with the collector's columns taken from fresh where it has a value; all other columns stay."""
    f = keep_first(fresh, [key], [F.to_json(F.struct(*owned)).asc()]).select(key, *[F.col(c).alias(f"_f_{c}") for c in owned])
    out = master.join(f, key, "left")
    return out.select(*[F.coalesce(f"_f_{c}", c).alias(c) if c in owned else F.col(c) for c in master.columns])


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Number of rows in which each field changed, nulls compared as values."""
    b = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in fields])
    both = after.join(b, key)
    flags = both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in fields])
    return flags.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c) for c in fields]))).alias("field", "changed"))


def amended(master: DataFrame, amendments: DataFrame, key: str, field: str, provenance: str) -> DataFrame:
    """master with one field replaced by the amendment's new value, and where it came from."""
    a = amendments.groupBy(key).agg(F.min("new_value").alias("_new"))
    out = master.join(a, key, "left")
    return out.select(*[F.coalesce("_new", field).alias(field) if c == field else F.when(F.col("_new").isNotNull(), "amended").otherwise(F.col(c)).alias(c) if c == provenance else F.col(c) for c in master.columns])


def detected(held: DataFrame, portal: DataFrame, key: str, status: str, year: str) -> DataFrame:
    """key, field, held, portal: a change of status, else of year, for records of exactly one designation."""
    h = held.select(F.col(key).alias("id"), ids.designation(F.col(key)).alias("_d"), F.col(status).alias("_s"), F.col(year).cast("string").alias("_y"))
    p = portal.select(ids.designation(F.col(key)).alias("_d"), F.col(status).alias("_ps"), F.col(year).cast("string").alias("_py"))
    p = p.groupBy("_d").agg(F.min(F.struct("_ps", "_py")).alias("p")).select("_d", "p._ps", "p._py")
    c = F.when(F.col("_s") != F.col("_ps"), F.struct(F.lit("status").alias("field"), F.col("_s").alias("held"), F.col("_ps").alias("portal"))).when(F.col("_y") != F.col("_py"), F.struct(F.lit("year").alias("field"), F.col("_y").alias("held"), F.col("_py").alias("portal")))
    return h.join(p, "_d").withColumn("c", c).filter("c is not null").select("id", "c.field", "c.held", "c.portal")


def amendment_summary(amendments: DataFrame) -> DataFrame:
    """One row from (id, field, held, portal): all amendments, changes of status, of the year, and current ones now withdrawn."""
    status = F.col("field") == "status"
    return amendments.agg(F.count(F.lit(1)).alias("amendments"), F.count_if(status).alias("status_changes"), F.count_if(~status).alias("year_changes"), F.count_if(status & (F.col("held") == "Current") & (F.col("portal") == "Withdrawn")).alias("current_to_withdrawn"))


def gap_filled(missing: DataFrame, wanted: str, records: DataFrame, number: str) -> DataFrame:
    """wanted, found: spellings are tried in order, and the first that a record answers to is taken."""
    tries = missing.select(F.col(wanted).alias("wanted"), F.posexplode(ids.variants(F.col(wanted))).alias("priority", "spelling"))
    exact = records.groupBy(F.col(number).alias("spelling")).agg(F.min(number).alias("found"))
    by_digits = records.groupBy(ids.digits(F.col(number)).alias("_d")).agg(F.min(number).alias("_near")).filter("_d != ''")
    hit = tries.join(exact, "spelling", "left").withColumn("_d", ids.digits(F.col("spelling"))).join(by_digits, "_d", "left")
    return hit.groupBy("wanted").agg(F.min_by(F.coalesce("found", "_near"), F.struct(F.col("found").isNull(), F.col("_near").isNull(), F.col("priority"))).alias("found"))


def ranked_gaps(edges: DataFrame, sources: list[DataFrame], held: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Ids of any source that aren't held, by how many edges they have; tasks: over how many ids are dealt, in place of the session's number."""
    dealt = lambda df: over_tasks(df, tasks, key)
    named = sources[0].select(F.col(sources[0].columns[0]).alias(key))
    for s in sources[1:]:
        named = named.unionByName(s.select(F.col(s.columns[0]).alias(key)))
    degree = dealt(edges.select(F.explode(F.array("src", "dst")).alias(key))).groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    return dealt(named).distinct().join(dealt(held.select(key)), key, "left_anti").join(degree, key, "left").fillna(0, ["degree"])


def merge_report(master: DataFrame, collected: DataFrame, key: str, year: str) -> DataFrame:
    """One row: how many are new, already held, had a year recovered, or disagree on the year."""
    m = master.select(key, F.col(year).alias("_y"), F.lit(True).alias("_held"))
    both = collected.join(m, key, "left")
    held = F.coalesce(F.col("_held"), F.lit(False))
    return both.agg(F.count_if(~held).alias("new"), F.count_if(held).alias("already"), F.count_if(held & F.col("_y").isNull() & F.col(year).isNotNull()).alias("recovered"), F.count_if(held & (F.col("_y") != F.col(year))).alias("disagreed"))
