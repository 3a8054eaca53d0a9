"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded order and given the fractional rank
``(rank + 1/2) / rows of the source``; all rows sorted by it hold every source in
proportion over any stretch, and are cut into shards whose row counts differ by one at
most (the law ``rows``). Ranks over a source and over the corpus are both made from
counts of ranges of the key, ordered, plus a rank within a range; there are about as many
ranges as a range has rows. So no source and no corpus is ever sorted in one task, and a
source with a third of all rows is spread over as many tasks as any other rows. Rows that
agree in id and text are numbered first, and the number is part of the key, so copies
are spread like other rows.

Edge cases: null texts count 8 bytes and have crc32 0, like empty ones; a null source is
a source; null ids are ordered by their texts; an empty table gives an empty result; rows
that agree in id and text are interchangeable and get places of their own; a very long
text is hashed where it is read and goes no further but in ``write``; columns of any
other names pass through ``write``, which adds ``shard`` and ``slot`` under names that
the input doesn't use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .mixing import range_bits

SEED = "shard-1"


def _ranked(rows: DataFrame, group: list[str], part: Column, order: list, name: str) -> DataFrame:
    """Adds ``name``, the rank from 0 within ``group`` by ``part`` and then ``order``, without sorting a group in one task."""
    rows = rows.withColumn("rank_part", part)
    key = [*group, "rank_part"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("rank_n"))
    upto = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.struct(*key).alias("rank_key"), F.coalesce(F.sum("rank_n").over(upto), F.lit(0)).alias("rank_before"))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    own = own.join(counts, F.struct(*key).eqNullSafe(F.col("rank_key")))
    return own.withColumn(name, F.col(name) + F.col("rank_before")).drop("rank_part", "rank_key", "rank_before")


def narrow(docs: DataFrame, *more: Column) -> DataFrame:
    """What decides about a row: ``doc_id, source, size, text_crc32, digest`` and ``more``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), *more)


def placed(rows: DataFrame, shards: int, seed: str) -> DataFrame:
    """Adds ``shard, slot`` to a table of ``narrow`` rows."""
    copies = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    numbered = rows.withColumn("number", F.lit(0).cast("long")) if copies.filter("n > 1").isEmpty() else shared.numbered(rows, F.struct("doc_id", "digest"), "number")
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("number").cast("string"))
    rows = shared.table(numbered.withColumn("key", F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")).drop("digest", "number"), "shard-keys")
    bits, by_row = range_bits(rows.count()), ["key", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, ["source"], F.shiftright("key", 60 - bits), by_row, "rank")
    counts = shared.small(rows.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n")), "shard-counts")
    total = rows.agg(F.count("*").alias("total"))
    # (2 rank + 1) / 2n in units of 2**-40, as an exact integer; ties by source
    spread = shared.table(ranked.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("at", F.expr("cast(((2 * rank + 1) * cast(1099511627776 as decimal(20,0))) div (2 * n) as long)")).drop("of", "n", "rank"), "shard-spread")
    out = _ranked(spread, [], F.shiftright("at", 40 - bits), ["at", F.col("source").asc_nulls_last(), *by_row], "position")
    shard = F.expr(f"cast((position * {shards}) div total as int)")
    first = F.expr(f"cast((shard * total + {shards - 1}) div {shards} as long)")
    out = out.join(F.broadcast(total)).withColumn("shard", shard)  # one row
    return out.withColumn("slot", F.col("position").cast("long") - first).drop("key", "at", "position", "total")


def assign(docs: DataFrame, shards: int = 24, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for every row."""
    return placed(shared.table(narrow(docs), "shard-rows"), shards, seed)


def write(docs: DataFrame, path: str, shards: int = 24, seed: str = SEED) -> tuple[str, str]:
    """Writes the rows of ``docs`` with all their columns to ``path/shard=k``, each shard in slot order; returns the names of the two columns added.

    The rows are staged once, so that each has a number to be found by.
    """
    work = shared.fresh(docs, "row")
    staged = shared.table(docs.withColumn(work, F.monotonically_increasing_id()), "shard-staged")
    place = placed(shared.table(narrow(staged, F.col(work).alias("row")), "shard-rows"), shards, seed)
    shard, slot = shared.fresh(docs, "shard"), shared.fresh(docs, "slot")
    rows = staged.join(place.select(F.col("row").alias(work), F.col("shard").alias(shard), F.col("slot").alias(slot)), work).drop(work)
    rows.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP8_SQL = f"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
hx AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents),
raw AS (SELECT doc_id, source, text, (len(hx) // 2 + 8)::BIGINT AS size, list_transform(range(len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM hx),
crc AS (SELECT doc_id, source, text, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM raw, tab),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text) - 1 AS number FROM crc),
keyed AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(text), number::VARCHAR)), 1, 15))::BIGINT AS k FROM num),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM keyed),
fraction AS (SELECT *, ((2 * rank + 1)::HUGEINT * 1099511627776) // (2 * n) AS place FROM ranked),
pos AS (SELECT *, row_number() OVER (ORDER BY place, source NULLS LAST, k, doc_id NULLS FIRST, text_crc32, size) - 1 AS position FROM fraction)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 24 // total)::INT AS shard,
  (position - (position * 24 // total * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM pos
"""
