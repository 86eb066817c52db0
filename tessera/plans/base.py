"""Bindings of the engine's tables to the benchmark tables, in DataFrames and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ROWS, tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Digits of the longest key: designations are made from keys, which are not bounded as those of the real register are.
KEY_DIGITS = 19


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (tables) under its name, with the SQL that must give the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def spread(df: DataFrame) -> DataFrame:
    """Texts of a scan of fewer splits than cores (files of one row group can't be split) are dealt over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df

    @property
    def register(self) -> DataFrame:
        """The part table as a register of designations."""
        year = F.col("p_size") + 1950
        status = F.when(F.col("p_size") >= 45, "Withdrawn").when(F.col("p_size") >= 40, "Superseded").otherwise("Current")
        number = F.concat(F.lit("IS "), F.col("p_partkey").cast("string"), F.lit(" (Part "), F.col("p_size").cast("string"), F.lit(") : "), year.cast("string"))
        return self.part.select(F.col("p_partkey").alias("pk"), number.alias("number"), F.concat("p_type", F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("family"), year.alias("year"), status.alias("status"))

    @property
    def parts(self) -> int:
        """Tasks of a bounded size for the lines."""
        return tasks(self.spark, self.lineitem.count(), ROWS)

    @property
    def bridge(self) -> DataFrame:
        """Orders as documents, the parts of their lines as what they cite, dealt by document over tasks of a bounded size."""
        return self.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item")).repartition(self.parts, "doc").distinct()

    @property
    def buyers(self) -> DataFrame:
        """Document, year, status and place in the hierarchy of buyers."""
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        who = self.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")  # nations: 25 rows
        return self.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("usability"), F.col("o_orderpriority").alias("source"), F.col("c_custkey").alias("buyer"), "c_mktsegment", F.col("n_name").alias("department"), F.col("r_name").alias("ministry"))


def inside(said, text: str = "text", key: str = "doc_id"):
    """A whole text with a phrase at a place of its own: documents by themselves name no entries."""
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.pmod(F.col(key) * 7919, F.char_length(t) + 1).cast("int")
    return F.concat(F.substring(t, F.lit(1), at), F.lit(" "), F.coalesce(said, F.lit("")) if not isinstance(said, str) else F.lit(said), F.lit(" "), F.substring(t, at + 1, F.char_length(t)))


def inside_sql(said: str) -> str:
    """The same in SQL: doc_id, t."""
    at = "((doc_id * 7919) % (length(coalesce(text, '')) + 1))"
    return f"SELECT doc_id, left(coalesce(text, ''), {at}) || ' ' || coalesce({said}, '') || ' ' || substr(coalesce(text, ''), {at} + 1) AS t FROM documents"


#: The same in SQL, as named table expressions.
REG = """reg AS (SELECT p_partkey AS pk, 'IS ' || p_partkey || ' (Part ' || p_size || ') : ' || (1950 + p_size) AS number,
    p_type || ' ' || p_name AS title, p_brand AS family, 1950 + p_size AS year,
    CASE WHEN p_size >= 45 THEN 'Withdrawn' WHEN p_size >= 40 THEN 'Superseded' ELSE 'Current' END AS status FROM part)"""
BRIDGE = "bridge AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS item FROM lineitem)"
BUYERS = """buyers AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS usability, o_orderpriority AS source,
    c_custkey AS buyer, c_mktsegment, n_name AS department, r_name AS ministry
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
