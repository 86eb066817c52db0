"""What operators share: written tables in the shared folder, checked broadcasts, joins that split hot keys."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is dealt over SALTS tasks; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 256
SALTS = 64
#: Bytes up to which a side whose size was measured is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless they find it where the driver did."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or any(p and Path(p).resolve() == root for p in known):
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a master of one machine."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_folders: dict[str, SparkSession] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _erase(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Removes what the application has written for itself, when the driver ends."""
    for path, spark in _folders.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _erase(spark, path)


def own_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    _folders[path] = spark
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives the executors that made them."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables that written() gave, of which nothing that is still to run reads."""
    for df in tables:
        path = _written.pop(df, None)
        if path:
            _erase(df.sparkSession, path)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if rows * row_bytes, both known, stay under BROADCAST_BYTES; else df as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, spread: Column, how: str = "left", tasks: int | None = None) -> DataFrame:
    """rows ⋈ groups, where groups has one row for each key and ``count`` its number of rows of ``total``.

    Keys above HOT_SHARE (at most 256, so their list is broadcast) are dealt over SALTS tasks: their rows by
    ``spread``, their group's row to each of them. All other keys go by the key alone. Keys must not be null. tasks: over how
    many the join is dealt, in place of the session's number.
    """
    warm, salt = (fresh(n, [*rows.columns, *groups.columns]) for n in ("_hot", "_salt"))
    hot = F.col(count) > F.lit(max(1.0, total * HOT_SHARE))
    hot_keys = F.broadcast(groups.filter(hot).select(*keys, F.lit(True).alias(warm)))
    dealt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    left = rows.join(hot_keys, keys, "left").withColumn(salt, F.when(F.col(warm), dealt).otherwise(F.lit(0))).drop(warm)
    right = groups.withColumn(salt, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    if tasks:
        left, right = (x.repartition(tasks, *keys, salt) for x in (left, right))
    return left.join(right, [*keys, salt], how).drop(salt)


def over_tasks(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by its keys over a number of tasks that goes with its size; None leaves it to the session's number."""
    return df.repartition(tasks, *keys) if tasks else df


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores in front as it takes to be none of ``taken``."""
    while name in taken:
        name = f"_{name}"
    return name
