"""Postings in blocks with the largest weight of each, and an exact top-k that leaves out blocks which can't enter.

A block is a set of some ``BLOCK`` chunks of like length, the same for every term: lengths fall into
buckets by their logarithm, and a bucket's chunks are dealt over its blocks by the hash of their
ids, so no chunk is numbered and a block is bounded however many chunks have one length. A
term has one row a block, with its postings there and the largest weight of any of them.

The sum of a query's terms' largest weights bounds the score of every chunk of a block. The ``top_k``
blocks of the best bounds hold at least that many hits; the score of the last of these leaves
only blocks whose bound isn't below it, and just their postings are read apart from their
bounds. What is left out can't enter, so ranks are those of ``bm25.search``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .bm25 import Index, asked_terms, ranked, weight

BLOCK = 32
STEPS = 16  # buckets of lengths per factor e
SLACK = 1e-6  # scores are rounded to 6 digits


@dataclass
class Impacts:
    """``blocks (term, block, n, impact, postings)`` sorted by term and block, made of ``index``."""

    index: Index
    blocks: DataFrame

    def search(self, queries: DataFrame, top_k: int = 10, include_zero: bool = False) -> DataFrame:
        return search(self, queries, top_k, include_zero)


def build(index: Index, keep=scratch.table, block: int = BLOCK) -> Impacts:
    bucket = F.floor(F.log(F.col("dl") + 1.0) * STEPS).cast("int")
    # a row a bucket: some hundreds, whatever the chunks
    slots = index.lengths.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / block).cast("int").alias("slots"))
    rows = index.postings.withColumn("bucket", bucket).join(F.broadcast(slots), "bucket").join(F.broadcast(index.corpus.select("avgdl")))  # one row
    at = F.shiftleft(F.col("bucket").cast("long"), 32) + F.pmod(F.xxhash64("chunk_id"), F.col("slots"))
    out = rows.groupBy("term", at.alias("block")).agg(
        F.count("*").alias("n"), F.max(weight(F.col("tf"), F.col("dl"))).alias("impact"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("postings")
    )
    # a group is where it was dealt to: a second deal by ranges would shuffle all postings again
    return Impacts(index, keep(out.sortWithinPartitions("term", "block")))


def saved(impacts: Impacts, path: str) -> None:
    impacts.blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(path)


def loaded(spark: SparkSession, index: Index, path: str) -> Impacts:
    return Impacts(index, spark.read.parquet(path))


def _scores(impacts: Impacts, visits: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks in the blocks of ``visits (query_id, term, block, times, idf)``."""
    hit = impacts.blocks.select("term", "block", "postings").join(visits, ["term", "block"])
    rows = hit.select("query_id", "times", "idf", F.inline("postings")).join(F.broadcast(impacts.index.corpus.select("avgdl")))  # one row
    part = F.col("times") * F.col("idf") * weight(F.col("tf"), F.col("dl"))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def _plan(impacts: Impacts, queries: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bounds of terms, what is visited first, its scores, what is visited then)"""
    asked = asked_terms(impacts.index, queries)
    terms = impacts.blocks.select("term", "block", "n", "impact").join(asked, "term")
    terms = scratch.table(terms.select("query_id", "term", "block", "n", "times", "idf", F.greatest(F.lit(0.0), F.col("times") * F.col("idf") * F.col("impact")).alias("most")), "bounds")
    bounds = scratch.table(terms.groupBy("query_id", "block").agg(F.sum("most").alias("bound")), "block-bounds")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    best = bounds.withColumn("nth", nth).filter(F.col("nth") <= top_k).select("query_id", "block")
    columns = ["query_id", "term", "block", "times", "idf", "n"]
    first = scratch.small(terms.join(best, ["query_id", "block"]).select(*columns), "first-visits")
    found = scratch.table(_scores(impacts, first), "first-scores")
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = found.withColumn("nth", kth).filter(F.col("nth") == top_k).select("query_id", (F.col("score") - SLACK).alias("least"))
    left = bounds.join(least, "query_id", "left").filter("least IS NULL OR bound >= least").join(first.select("query_id", "block").distinct(), ["query_id", "block"], "left_anti")
    later = scratch.small(terms.join(left.select("query_id", "block"), ["query_id", "block"]).select(*columns), "later-visits")
    return terms, first, found, later


def search(impacts: Impacts, queries: DataFrame, top_k: int = 10, include_zero: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``, as ``bm25.search`` gives it."""
    _, _, found, later = _plan(impacts, queries, top_k)
    return ranked(impacts.index, found.unionByName(_scores(impacts, later)), queries, top_k, include_zero)


def postings_read(impacts: Impacts, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """``term, read, postings``: of each term asked for, the postings that a search scores and those there are, summed over the queries."""
    terms, first, _, later = _plan(impacts, queries, top_k)
    read = first.unionByName(later).groupBy("term").agg(F.sum("n").alias("read"))
    return terms.groupBy("term").agg(F.sum("n").alias("postings")).join(read, "term", "left").select("term", F.coalesce("read", F.lit(0)).alias("read"), "postings")
