"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources in code-point order, null last, weigh ``weights`` in turn. Together they are to
give ``share`` of all words; a source is clamped at ``most`` times its own size, and what
it cannot give goes to the others by weight, until none is above. The level that this
process ends at has a closed form: with sources by rising cap per weight, the first one
that the level then due does not fill, sets the level of itself and all after it.

A target is met by whole and fractional repetitions: every document of the source
``floor(target / size)`` times, and once more those that come first in a seeded order,
up to the words that are missing. The one on the edge is taken if that comes nearer.

No group meets in one task: a source's seeded order is cut into about as many ranges of
the hash as a range then has rows, the sums of the ranges are ordered, and only the range
with the edge is ordered by rows. Rows that agree in id and text are one entry with a
count there, of which some may be taken; these are numbered by the tasks that read them.
What is joined to the documents is a row per source, so documents aren't shuffled.

Edge cases: null and empty texts have size 0 and are taken 0 words; an empty table gives
an empty result; null ids are ordered by their texts; of rows equal in id and text any
may be the ones that are taken once more, as many as meet the target; a null source is a
source; a very long text is one row with its size; working columns are two structs under
names that the input doesn't use, and columns of any name pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def order_key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of the md5 of seed, id and text: the seeded order, the same in any SQL engine."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def range_bits(rows: int) -> int:
    """Bits of the key that cut ``rows`` into about as many ranges as each then has rows."""
    return max(4, math.ceil(math.log2(max(rows, 1)) / 2))


def levels(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` of a frame with ``source, size``: a row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    ranked = sums.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("nth") % len(weights)).cast("int") + 1))
    by_cap = every.orderBy(most * F.col("source_size") / F.col("weight"), "nth")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    due = (share * total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    # every source from the first unfilled one on is due the same level
    unfilled = F.when(F.col("due") * F.col("weight") <= most * F.col("source_size"), F.col("due"))
    level = F.first(unfilled, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cap = most * F.col("source_size")
    levelled = weighed.withColumn("due", due).withColumn("level", level)
    return levelled.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def goals(sized: DataFrame, weights, share: float, most: float, bits: int) -> DataFrame:
    """A row per source: its size and target, how often all of it is taken, and up to which row of the seeded order once more.

    ``last`` is the last entry that is taken again, ``more`` of its ``n`` equal rows.
    """
    goal = levels(sized, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = shared.small(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    rest = goal.select(F.col("source").alias("of"), "rest")
    part = F.shiftright("key", 60 - bits)
    sums = sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).join(rest, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # the range of the hash with the edge, and in it the entries by hash and id
    edge = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") >= F.col("rest")))
    edge = shared.small(edge.select(F.col("source").alias("edge_source"), F.col("part").alias("edge_part"), "before", "rest"), "mix-edges")
    inner = sized.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (part == F.col("edge_part")))
    inner = inner.groupBy("source", "before", "rest", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(run), F.lit(0))
    # a row is taken if that comes nearer: while more than half of it is missing
    first = 2 * F.col("left") > F.col("size")
    some = F.least(F.col("n"), F.ceil(F.col("left") / F.col("size") - 0.5))
    more = F.when(~first, 0).when((F.col("n") == 1) | (F.col("size") == 0), F.col("n")).otherwise(F.greatest(some, F.lit(1)))
    cut = inner.withColumn("left", left).withColumn("more", more.cast("long")).filter("more > 0")
    last = cut.groupBy(F.col("source").alias("cut_source")).agg(F.max(F.struct("key", "doc_id", "size", "more", "n")).alias("cut"))
    # without such a row the ranges before the edge are all that is taken
    out = goal.join(edge.drop("before", "rest"), F.col("source").eqNullSafe(F.col("edge_source")), "left").join(last, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    entry = F.when(F.col("cut").isNotNull(), F.struct("cut.key", "cut.doc_id", "cut.size"))
    return out.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", "edge_part", entry.alias("last"), "cut.more", "cut.n")


def planned(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` and a last column, a struct of ``size, source_size, target, times``; it is named ``mix`` where that is free."""
    work = shared.fresh(docs, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn(work, F.struct(order_key(F.col("doc_id"), F.col("text"), seed).alias("key"), size.alias("size")))
    sized = shared.table(rows.select("doc_id", "source", f"{work}.key", f"{work}.size"), "mix-sizes")
    bits = range_bits(sized.count())
    found = shared.small(goals(sized, weights, share, most, bits), "mix-cuts")
    goal = shared.fresh(rows, "goal")
    rows = rows.join(found.select(F.struct("*").alias(goal)), F.col("source").eqNullSafe(F.col(f"{goal}.of")))
    of = lambda c: F.col(f"{goal}.{c}")
    part, entry = F.shiftright(F.col(f"{work}.key"), 60 - bits), F.struct(F.col(f"{work}.key").alias("key"), "doc_id", F.col(f"{work}.size").alias("size"))
    at_edge = F.coalesce(part == of("edge_part"), F.lit(False)) & of("last").isNotNull()
    tie = at_edge & (of("rest") > 0) & (entry == of("last")) & (of("more") < of("n"))
    again = F.when(of("rest") <= 0, False).when(of("edge_part").isNull() | (part < of("edge_part")), True).otherwise(at_edge & (entry <= of("last")))

    def told(rows: DataFrame, again: Column) -> DataFrame:
        times = (of("whole") + F.coalesce(again, F.lit(False)).cast("int")).cast("int")
        return rows.withColumn(work, F.struct(F.col(f"{work}.size").alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), times.alias("times"))).select(*docs.columns, work)

    if found.filter("more < n").isEmpty():
        return told(rows, again)
    number = shared.fresh(rows, "number")
    tied = shared.numbered(rows.filter(F.coalesce(tie, F.lit(False))), of("of"), number)
    return told(rows.filter(~F.coalesce(tie, F.lit(False))), again).unionByName(told(tied, F.col(number) < of("more")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it, with all columns."""
    rows = planned(docs, **options)
    times = F.col(f"{rows.columns[-1]}.times")
    return rows.filter(times > 0).withColumn(shared.fresh(rows, "copy"), F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    per = planned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    taken = (F.col("mix.times") * F.col("mix.size")).cast("long")
    return per.select("doc_id", "mix.size", "mix.source_size", F.col("mix.target").cast("double").alias("target"), taken.alias("taken"))


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sums),
dues AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE
    - 2.0 * coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS due FROM weighed),
lev AS (SELECT arg_min(due, 2.0 * source_size / weight) AS level FROM dues WHERE due * weight <= 2.0 * source_size),
goals AS (SELECT source, source_size, least(2.0 * source_size::DOUBLE, coalesce(level * weight, 2.0 * source_size::DOUBLE)) AS target FROM dues, lev),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM goals),
run AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, g.rest,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS done
  FROM sized s JOIN rests g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN 2 * (rest - done) > size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""
