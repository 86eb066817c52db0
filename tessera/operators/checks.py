"""Invariants between tables. A check yields its violations; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plumbing import over_tasks

CHECKS: dict[str, Callable[..., DataFrame]] = {}


def check(name: str):
    """Registers a function as a named check."""

    def add(f):
        CHECKS[name] = f
        return f

    return add


@check("sets_agree")
def sets_agree(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, with the side that lacks them."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").filter("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))


@check("endpoints_known")
def endpoints_known(edges: DataFrame, known: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Graph nodes that no table knows; tasks: over how many nodes are dealt, in place of the session's number."""
    nodes = over_tasks(edges.select(F.explode(F.array("src", "dst")).alias(key)), tasks, key).distinct()
    return nodes.join(over_tasks(known.select(key), tasks, key), key, "left_anti")


@check("thresholds_hold")
def thresholds_hold(edges: DataFrame, co: int, confidence: float, source: int) -> DataFrame:
    """Edges under a threshold that the graph was built with."""
    return edges.filter((F.col("co") < co) | (F.col("confidence") < confidence) | (F.col("n_src") < source))


@check("counts_agree")
def counts_agree(stated: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """Numbers stated elsewhere that differ from a count."""
    c = counted.select(key, F.col(n).alias("_n"))
    return stated.join(c, key, "full").filter(~F.col(n).eqNullSafe(F.col("_n"))).select(key, F.col(n).alias("stated"), F.col("_n").alias("counted"))


@check("accounted")
def accounted(all_: DataFrame, parts: list[DataFrame], key: str, tasks: int | None = None) -> DataFrame:
    """Keys that are in none of the parts, or in more than one; tasks: over how many keys are dealt, in place of the session's number."""
    dealt = lambda df: over_tasks(df, tasks, key)
    seen = None
    for p in parts:
        k = dealt(p.select(key)).distinct()
        seen = k if seen is None else seen.unionByName(k)
    n = dealt(seen).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dealt(all_.select(key)).distinct().join(n, key, "left").filter("n is null or n != 1")


@check("well_formed")
def well_formed(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.select(column).filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


@check("reproduced")
def reproduced(stored: DataFrame, again: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose stored value differs from one derived again."""
    return stored.join(again.select(key, F.col(value).alias("_again")), key).filter(~F.col(value).eqNullSafe(F.col("_again"))).select(key, F.col(value).alias("stored"), "_again")


@check("bounded")
def bounded(df: DataFrame, column: str, low: Column | float, high: Column | float) -> DataFrame:
    return df.filter((F.col(column) < low) | (F.col(column) > high))


@check("unchanged_unless_applied")
def unchanged_unless_applied(runs: DataFrame) -> DataFrame:
    """Dry runs (apply is false) that say they changed something."""
    return runs.filter(~F.col("apply") & (F.col("changed") > 0))


@check("answerable")
def answerable(golden: DataFrame, register: DataFrame, expected: str, key: str) -> DataFrame:
    """Golden queries whose expected answer the register doesn't hold."""
    return golden.join(register.select(F.col(key).alias(expected)), expected, "left_anti")


@check("complete_notifications")
def complete_notifications(rules: DataFrame, reference: str) -> DataFrame:
    """Notifications that, as shown, stop inside a word of their reference."""
    from ..functions.citations import cut_short, notification

    return rules.withColumn("_shown", notification(F.col(reference))).filter(cut_short(F.col("_shown"), F.col(reference)))


@check("screens_agree")
def screens_agree(counts: dict[str, DataFrame]) -> DataFrame:
    """One-row counts that should be one number: the screens whose number isn't that of the first."""
    out = None
    for name, df in counts.items():
        one = df.select(F.lit(name).alias("screen"), F.col(df.columns[0]).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    first = out.filter(F.col("screen") == next(iter(counts))).select(F.col("n").alias("_n"))
    return out.crossJoin(F.broadcast(first)).filter(~F.col("n").eqNullSafe(F.col("_n"))).select("screen", "n")  # first is one row


def report(results: dict[str, DataFrame]) -> DataFrame:
    """A row for each check: violations, and whether it passed."""
    out = None
    for name, df in results.items():
        one = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
