"""Tables and files between stages, in the folder that the driver and all executors share.

Everything lives under ``spark.checkpoint.dir``. Only in local mode, where driver and
executors are one process, is a folder of our own made if a session names none; on a
cluster that is an error, as each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MADE: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()
_HELD: weakref.WeakKeyDictionary[SparkSession, dict] = weakref.WeakKeyDictionary()
_AT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master} has executors that share no local one")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder URI under the shared root; made by whoever writes to it first."""
    path = f"{root(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark, []).append(path)
    return path


def table(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _AT[out] = path
    return out


@contextlib.contextmanager
def shuffled(spark: SparkSession, parts: int):
    """What is written inside is dealt to ``parts`` partitions at least, so that a task's share doesn't grow with the input where a session's setting is fixed.

    Few groups are gathered without a sort: a partition's are bounded by then.
    """
    named = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": parts, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": 100_000}
    was = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            if was[k] is not None and int(was[k]) < v:
                spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in was.items():
            if v is not None:
                spark.conf.set(k, v)


def dealt(df: DataFrame, parts: int, *keys) -> DataFrame:
    """``df`` dealt by keys to ``parts`` partitions where that is more than a session's setting gives: for a join or grouping by these keys that is not run at once (else ``shuffled``)."""
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def small(df: DataFrame, name: str, rows: int = 100_000, size: int = 16 << 20) -> DataFrame:
    """``df`` as a table, marked for broadcast only if it turns out to have few rows of few bytes; joins work either way."""
    out = table(df, name)
    held = F.lit(0)
    for column, kind in out.dtypes:
        own = F.lit(16) if kind in _FIXED else F.octet_length(F.col(f"`{column}`").cast("string")) + 16
        held = held + F.coalesce(own, F.lit(16))
    told = out.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).first()
    return F.broadcast(out) if told["n"] <= rows and (told["bytes"] or 0) <= size else out


def once(spark: SparkSession, key, make):
    """What ``make`` returns, made once for a key; made anew after ``release``, which deletes the tables that it may read."""
    held = _HELD.setdefault(spark, {})
    if key not in held:
        held[key] = make()
    return held[key]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a shared folder through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` returned, once all that was made of them is itself written."""
    for df in tables:
        remove(df.sparkSession, _AT.pop(df))


def release(spark: SparkSession) -> None:
    """Deletes all that this session wrote; call it when results made of it are no longer read. What ``once`` holds is forgotten."""
    _HELD.pop(spark, None)
    for path in _MADE.pop(spark, []):
        remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """A scanned table, dealt over the session's cores, or over more tasks where these would hold more than some ``rows`` each; what is read in as many is left as it is.

    For stages whose work by far outweighs their rows. What is given should be a scan: other plans are run to be counted.
    """
    parts = tasks(df, rows)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, *keys)


def tasks(df: DataFrame, rows: int = 20_000) -> int:
    """In how many tasks some ``rows`` are a task's, as many as there are cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
