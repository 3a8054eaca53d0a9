"""LIKE over names by posting lists of their q-grams.

A name is held once, by a hash, with the distinct runs of one to three characters of its
lower-cased form. What a pattern has between its wildcards must be in a name that fits:
runs of three and more give their three-character pieces, shorter ones themselves. The
postings of a pattern's rarest pieces are intersected and the names that are left compared
with the whole pattern, so the result is that of comparing all names; a pattern without any
literal character fits by an empty piece that every name has. Nothing is a nested loop, and
a piece that many names have is read only for patterns that have no rarer one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

SIZE = 3
RAREST = 3


@dataclass
class NameIndex:
    """``names (id, name)``, ``postings (gram, id)`` sorted by gram, ``counts (gram, n)``."""

    names: DataFrame
    postings: DataFrame
    counts: DataFrame


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pieces(pattern: Column) -> Column:
    """What a name must hold to fit a pattern; one empty piece if that is nothing."""
    literal = F.split(F.lower(pattern), "[%_]")
    own = F.flatten(F.transform(literal, lambda x: F.when(F.length(x) >= SIZE, _runs(x, SIZE)).when(x == "", F.array().cast("array<string>")).otherwise(F.array(x))))
    return F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.array(F.lit("")))


def build(named: DataFrame, keep=lambda df: df) -> NameIndex:
    """The index of the distinct ``name``s; null names are in none. ``keep`` holds its tables."""
    names = keep(named.select("name").filter("name is not null").distinct().select(F.xxhash64("name").alias("id"), "name"))
    low = F.lower("name")
    every = F.array_distinct(F.concat(F.array(F.lit("")), *(_runs(low, n) for n in range(1, SIZE + 1))))
    # a frequent piece is in several tasks, each a range of its names
    postings = keep(names.select(F.explode(every).alias("gram"), "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"))
    return NameIndex(names, postings, keep(postings.groupBy("gram").agg(F.count("*").alias("n"))))


def lookup(index: NameIndex, patterns: DataFrame) -> DataFrame:
    """``pattern, name``: the names that hold each distinct ``pattern``, letter case aside; ``_`` and ``%`` in it are wildcards, a backslash is itself."""
    asked = patterns.select("pattern").filter("pattern is not null").distinct()
    asked = asked.withColumn("gram", F.explode(pieces(F.col("pattern")))).join(index.counts, "gram", "left")
    own = Window.partitionBy("pattern")  # as many rows as a pattern has characters
    asked = asked.withColumn("place", F.row_number().over(own.orderBy("n", "gram"))).withColumn("unknown", F.max(F.col("n").isNull()).over(own)).withColumn("all", F.count("*").over(own))
    asked = asked.filter(~F.col("unknown") & (F.col("place") <= RAREST)).select("pattern", "gram", F.least("all", F.lit(RAREST)).alias("wanted"))
    # few patterns are sent to where the postings are
    found = index.postings.join(scratch.small(asked, "asked-grams"), "gram").groupBy("pattern", "id").agg(F.count("*").alias("met"), F.first("wanted").alias("wanted")).filter("met = wanted")
    escaped = F.replace("pattern", F.lit("\\"), F.lit("\\\\"))
    rows = found.select("pattern", "id", escaped.alias("escaped")).join(index.names, "id")
    return rows.filter(F.expr("name ilike concat('%', escaped, '%')")).select("pattern", "name")
