"""Connected components of links held as a DataFrame, by alternating large and small stars.

Nothing is gathered on the driver but a count and a checksum per round. A node with very
many links is met by partial minima, and in joins its links are spread by ``SALTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


SALTS = 8


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links (u, v)`` with the ``m`` of ``least (u, m)``; the links of a node meet it in several tasks."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    every = least.select(F.col("u").alias("w"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    # merged, as estimates of small files would have it broadcast
    return links.withColumn("s", salt).join(every.hint("merge"), (F.col("u") == F.col("w")) & (F.col("s") == F.col("t")))


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _met(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the component's least node) of every node of ``links (u, v)`` but the least ones themselves."""
    e = links.select("u", "v").filter("u <> v")
    before = None
    while True:
        e = shared.table(_small(shared.table(_large(e), "stars")), "stars")
        state = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
