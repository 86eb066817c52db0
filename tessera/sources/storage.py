"""Tables that can be replaced or amended while they are read: versions, and a pointer that is committed last.

A store is a folder of named tables. A change writes new files beside the old ones, then creates one small pointer that
names the files of every table; that file is created exclusively, so that of two writers of a version one fails. A change
that dies before leaves files that no pointer names. Readers take the newest whole pointer, and so never see half a change,
nor a table of one version beside a count of another.

Tables with a key are dealt into hash buckets, and a change writes only the buckets it touches. Buckets of many rows are written
by several tasks each, so that a task's part doesn't grow with the table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket that one task writes; buckets of more are dealt over several.
ROWS = 1_000_000


@dataclass
class Staged:
    """Files that were written for a table, by bucket; ``touched`` are the buckets they stand for (None: all)."""

    schema: str
    parts: dict[str, str]
    rows: dict[str, int]
    touched: list[int] | None = None


@dataclass
class Pointer:
    version: int = -1
    batch: int = -1
    facts: dict = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)

    def rows(self, name: str, only: list[int] | None = None) -> int | None:
        """Rows of a table or of some of its buckets, as they were counted from its files; None if there is no such table."""
        if name not in self.tables:
            return None
        return sum(n for b, n in self.tables[name]["rows"].items() if only is None or b == "all" or int(b) in only)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _listed(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return [int(x[:-5]) for x in self._listed(f"{self.path}/_pointers") if x.endswith(".json") and x[:-5].isdigit()]

    def _pointer(self, version: int) -> Pointer | None:
        rows = self.spark.read.text(f"{self.path}/_pointers/{version:012d}.json", wholetext=True).collect()  # one small file
        try:
            return Pointer(**json.loads(rows[0].value))
        except (IndexError, ValueError):  # its writer died
            return None

    def pointer(self) -> Pointer:
        """The newest version; before the first, one without tables."""
        for n in reversed(self._numbers()):
            found = self._pointer(n)
            if found is not None:
                return found
        return Pointer()

    def bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, key: list[str]) -> list[int]:
        """Buckets that rows of df are in: as many as the store has at most."""
        return sorted(r[0] for r in df.select(self.bucket(key)).distinct().collect())

    def read(self, name: str, only: list[int] | None = None, at: Pointer | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None if there is no such table."""
        entry = (at or self.pointer()).tables.get(name)
        if entry is None:
            return None
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = [p for b, p in entry["parts"].items() if only is None or b == "all" or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def dealt(self, df: DataFrame, key: list[str], rows: int = 0, touched: int | None = None) -> DataFrame:
        """The rows with their _bucket and _task, each task's where it is written; rows: how many there are, at most, in
        so many touched buckets (None: all)."""
        each = max(-(-rows // (max(self.buckets if touched is None else touched, 1) * ROWS)), 1)
        task = F.col("_bucket") * each + F.pmod(F.hash(*key), F.lit(each))
        return df.withColumn("_bucket", self.bucket(key)).withColumn("_task", task.cast("int")).repartitionById(self.buckets * each, F.col("_task"))

    def stage(self, name: str, df: DataFrame, key: list[str] | None = None, touched: list[int] | None = None, rows: int = 0, summed: str | None = None) -> Staged:
        """Writes rows for a table, beside what is there; rows: how many there are at most, if that is known.

        summed: a column of counts that are added up where rows have the same key.
        """
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        if key is None:
            df.write.parquet(folder)
            parts = {"all": folder}
        else:
            out = self.dealt(df, key, rows, None if touched is None else len(touched))
            out = out.groupBy("_bucket", "_task", *key).agg(F.sum(summed).alias(summed)) if summed else out
            out.drop("_task").write.partitionBy("_bucket").parquet(folder)
            parts = {x.removeprefix("_bucket="): f"{folder}/{x}" for x in self._listed(folder) if x.startswith("_bucket=")}
        written = self.spark.read.schema(df.schema)
        where = F.regexp_extract(F.col("_metadata.file_path"), "/_bucket=([0-9]+)/", 1)
        held = {r[0] or "all": r[1] for r in written.parquet(folder).groupBy(where).count().collect()}
        return Staged(df.schema.json(), parts, {b: held.get(b, 0) for b in parts}, touched)

    def commit(self, staged: dict[str, Staged], batch: int | None = None, facts: dict | None = None) -> Pointer:
        """Makes what was staged the newest version, all tables at once."""
        old = self.pointer()
        tables = dict(old.tables)
        for name, s in staged.items():
            before = tables.get(name, {"parts": {}, "rows": {}})
            stay = {b for b in before["parts"] if s.touched is not None and b != "all" and int(b) not in s.touched}
            keep = lambda kind: {b: x for b, x in before[kind].items() if b in stay}  # noqa: B023, E731
            tables[name] = {"schema": s.schema, "parts": keep("parts") | s.parts, "rows": keep("rows") | s.rows}
        version = max(self._numbers(), default=-1) + 1
        new = Pointer(version, old.batch if batch is None else batch, {**old.facts, **(facts or {})}, tables)
        fs, p = self._at(f"{self.path}/_pointers/{version:012d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        return new

    def replace(self, name: str, df: DataFrame, key: list[str] | None = None, **more) -> Pointer:
        return self.commit({name: self.stage(name, df, key)}, **more)

    def vacuum(self, keep: int = 1) -> None:
        """Removes files that none of the last ``keep`` versions names: for the store's only writer, between changes."""
        numbers = self._numbers()
        last = [p for p in (self._pointer(n) for n in numbers[-keep:]) if p]
        if not last:
            return
        named = {path.removeprefix(f"{self.path}/") for p in last for t in p.tables.values() for path in t["parts"].values()}
        for name in self._listed(self.path):
            if name == "_pointers":
                continue
            for folder in self._listed(f"{self.path}/{name}"):
                own = f"{name}/{folder}"
                inside = {n for n in named if n == own or n.startswith(f"{own}/")}
                doomed = [own] if not inside else [] if own in inside else [f"{own}/{x}" for x in self._listed(f"{self.path}/{own}") if x.startswith("_bucket=") and f"{own}/{x}" not in inside]
                for x in doomed:
                    fs, p = self._at(f"{self.path}/{x}")
                    fs.delete(p, True)
        for n in numbers[:-keep]:
            fs, p = self._at(f"{self.path}/_pointers/{n:012d}.json")
            fs.delete(p, False)


def added(store: Store, at: Pointer, name: str, delta: DataFrame, key: list[str], value: str) -> Staged:
    """The table with the counts of delta added to its own, in the buckets that delta touches."""
    touched = store.touched(delta, key)
    old = store.read(name, touched, at)
    rows, many = delta.select(*key, value), delta.count()
    if old is not None:
        rows, many = old.select(*key, value).unionByName(rows), many + at.rows(name, touched)
    return store.stage(name, rows, key, touched, many, value)


def bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, sort: str | None = None) -> DataFrame:
    """A catalogue table whose files are dealt by the hash of a key and sorted, with statistics of its columns: joins and
    groupings by that key then shuffle nothing."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.format("parquet").option("path", path).mode("overwrite")
    writer.bucketBy(buckets, key).sortBy(key, *[c for c in [sort] if c]).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)
