"""Evaluation: confusion, ranking measures, calibration, leaderboards and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & ~predicted).alias("tn"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))


def ranking(judged: DataFrame, k: int = 10, precision_at: int = 5) -> DataFrame:
    """One row from (query, rank, relevant): recall at 1 and k, mean precision, and the number of queries."""
    q = judged.groupBy("query").agg(F.max((F.col("relevant") & (F.col("rank") == 1)).cast("int")).alias("r1"), F.max((F.col("relevant") & (F.col("rank") <= k)).cast("int")).alias("rk"), (F.count_if(F.col("relevant") & (F.col("rank") <= precision_at)) / precision_at).alias("p"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r1"), 4).alias("recall_1"), F.round(F.avg("rk"), 4).alias("recall_k"), F.round(F.avg("p"), 4).alias("precision"))


def abstentions(answers: DataFrame) -> DataFrame:
    """One row from (query, abstained, found: the answer is in the shortlist): abstentions, and those that were correct."""
    return answers.agg(F.count(F.lit(1)).alias("queries"), F.count_if("abstained").alias("abstained"), F.count_if(F.col("abstained") & ~F.col("found")).alias("correct"))


def mismatches(df: DataFrame, key: str, truth: Column, predicted: Column) -> DataFrame:
    """key, truth, predicted of the rows where they differ, or where one is unknown."""
    return df.select(key, truth.alias("truth"), predicted.alias("predicted")).filter(~F.col("truth").eqNullSafe(F.col("predicted")))


def outside(answers: DataFrame, register: DataFrame, answer: str, key: str) -> DataFrame:
    """pipeline, outside: answers of each pipeline that the register doesn't hold."""
    held = register.select(F.col(key).alias(answer)).distinct().withColumn("_held", F.lit(True))
    return answers.join(held, answer, "left").groupBy("pipeline").agg(F.count_if(F.col(answer).isNotNull() & F.col("_held").isNull()).alias("outside"))


def by_family(judged: DataFrame, family: str, least: int = 8) -> DataFrame:
    """Rank-1 accuracy of each family with enough queries."""
    return judged.filter("rank = 1").groupBy(family).agg(F.count(F.lit(1)).alias("queries"), F.count_if("relevant").alias("right")).filter(F.col("queries") >= least).withColumn("accuracy", F.round(F.col("right") / F.col("queries"), 4))


def calibration(df: DataFrame, score: Column, right: Column) -> DataFrame:
    """Buckets of a tenth: queries, right ones, accuracy."""
    bucket = F.least(F.floor(score * 10) / 10, F.lit(0.9))
    g = df.select(F.round(bucket, 1).alias("bucket"), right.cast("int").alias("_r")).groupBy("bucket").agg(F.count(F.lit(1)).alias("queries"), F.sum("_r").alias("right"))
    return g.withColumn("accuracy", F.round(F.col("right") / F.col("queries"), 4))


def expected_error(buckets: DataFrame) -> DataFrame:
    """Mean distance of accuracy from the middle of its bucket, weighted by queries."""
    gap = F.col("queries") * F.abs(F.col("right") / F.col("queries") - (F.col("bucket") + 0.05))
    return buckets.agg(F.round(F.sum(gap) / F.sum("queries"), 4).alias("ece"), F.sum("queries").alias("queries"), F.sum("right").alias("right"))


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Exact paired test over discordant pairs: n, k and p = min(1, 2 sum of C(n, i) / 2^n for i to k), in logarithms.

    The sum runs over an array of k + 1 terms in the one result row.
    """
    d = df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # running logarithm of C(n, i): each term from the one before
    terms = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum")), lambda s, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("log_c"), (s["sum"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))) - n * F.log(F.lit(2.0)))).alias("sum")))
    return d.select("only_a", "only_b", n.alias("discordant"), F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms["sum"])), 6).alias("p"))


def leaderboard(measured: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registered pipeline with its measures; those not measured stay, with nulls. abstained is null without a gate."""
    m = measured.groupBy("pipeline").agg(F.count(F.lit(1)).alias("queries"), F.count_if("right").alias("rank_1"), F.count_if("in_list").alias("hits"), F.count_if("abstained").alias("_abstained"), F.round(F.avg("ms"), 1).alias("mean_ms"))
    return registry.join(m, "pipeline", "left").select("pipeline", "gate", "queries", "rank_1", "hits", F.when(F.col("gate"), F.col("_abstained")).alias("abstained"), "mean_ms")


def abstention_cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of what the first pipeline declines, how much the second answers, and how much of that is wrong."""
    x = a.filter("abstained").select("query").join(b, "query")
    return x.agg(F.count(F.lit(1)).alias("declined"), F.count_if(~F.col("abstained")).alias("answered"), F.count_if(~F.col("abstained") & ~F.col("right")).alias("wrong"))
