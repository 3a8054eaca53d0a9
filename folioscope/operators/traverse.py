"""H1-H4: bounded traversal of the graph, for all seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


#: Rows of a task in a round of a traversal, about.
ROWS = 250_000


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, keep=scratch.table, ends: DataFrame | None = None) -> DataFrame:
    """H1: ``seed, node, dist``: the nodes that outgoing edges reach, by their least distance, without the seed.

    ``seeds (seed)`` are nodes, or named as one likes beside their ``node``.

    A round joins the frontier with the edges and drops what was met before; seeds that no
    edge touches reach nothing. ``keep`` holds each frontier, which later rounds read again.
    With ``ends (node)`` the last round takes only edges to these: for those who ask for no other node.
    """
    spark, whole = edges.sparkSession, scratch.tasks(edges, ROWS)
    with scratch.shuffled(spark, whole):
        frontier = keep(seeds.select("seed", F.col("node" if "node" in seeds.columns else "seed").alias("node")).distinct())
    met = frontier.withColumn("dist", F.lit(0))
    for hop in range(1, max_hops + 1):
        if ends is not None and hop == max_hops:
            edges = edges.join(ends.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        # sorts compare numbers: ids of one kind start alike
        left, right = frontier.withColumn("at", F.xxhash64("node")), edges.select(F.xxhash64("src").alias("from"), "src", "dst")
        step = left.join(right, (F.col("at") == F.col("from")) & (F.col("node") == F.col("src")))
        if hop == 1:
            step = step.filter("not (dst <=> src)")  # all that is met is the seed, where it stands
        step = step.select("seed", F.col("dst").alias("node")).distinct()
        # a task's share is bounded by what is joined; a step may be some times as many
        with scratch.shuffled(spark, max(whole, 4 * scratch.tasks(frontier, ROWS))):
            if hop > 1:
                pair = F.xxhash64("seed", "node").alias("pair")
                step = step.select("seed", "node", pair).join(met.select("seed", "node", pair), ["pair", "seed", "node"], "left_anti").drop("pair")
            frontier = keep(step)
        met = met.unionByName(frontier.withColumn("dist", F.lit(hop)))
    return met.filter("dist > 0")


def reached_chunks(edges: DataFrame, seeds: DataFrame, chunk_entities: DataFrame, max_hops: int, worth) -> DataFrame:
    """``seed, chunk_id, w``: what an ``entity_id`` of ``seeds`` gives to the chunks of all that it reaches, ``worth(dist)`` for each.

    That is the same for every question, so it is summed before questions join.
    """
    reached = bfs(edges, seeds.select(F.col("entity_id").alias("seed")), max_hops, ends=chunk_entities.select(F.col("entity_id").alias("node")).distinct())
    at = chunk_entities.select(F.col("entity_id").alias("at"), "chunk_id")
    return reached.join(at, F.col("node") == F.col("at")).groupBy("seed", "chunk_id").agg(F.sum(worth(F.col("dist"))).alias("w"))


def semantic_starts(found: DataFrame) -> DataFrame:
    """H2: ``query_id, entity_id, score`` with the best score of each entity over the names of a query."""
    return found.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))


def related_chunks(names: DataFrame, entities: DataFrame, edges: DataFrame, chunk_entities: DataFrame, max_hops: int = 2, max_chunks: int = 10, semantic: DataFrame | None = None, index=None) -> DataFrame:
    """H3: ``query_id, chunk_id, score, rank``: 2 per seed's chunk and 1 / (d + 1) per chunk of what it reaches.

    Seeds are entities whose name holds a name of the query, once for each (a bag), or
    those of ``semantic (query_id, entity_id)`` for the queries that it has; ``index`` is that of
    the entities' names.
    """
    from pyspark.sql import Window

    from .graph_search import lexical as matched

    asked = names.groupBy("query_id", "name").agg(F.count("*").alias("times"))
    seeds = asked.join(matched(names, entities, index), "name").select("query_id", "entity_id", "times")
    if semantic is not None:
        own = semantic.select("query_id", "entity_id", F.lit(1).cast("long").alias("times"))
        seeds = seeds.join(semantic.select("query_id").distinct(), "query_id", "left_anti").unionByName(own)
    parts = scratch.tasks(edges, ROWS)
    with scratch.shuffled(edges.sparkSession, parts):
        seeds = scratch.table(seeds.groupBy("query_id", "entity_id").agg(F.sum("times").alias("times")), "related-seeds")
    at = chunk_entities.select(F.col("entity_id").alias("at"), "chunk_id")
    direct = seeds.join(at, F.col("entity_id") == F.col("at")).select("query_id", "chunk_id", (2.0 * F.col("times")).alias("s"))
    worth = reached_chunks(edges, seeds, chunk_entities, max_hops, lambda dist: 1.0 / (dist + 1))
    far = seeds.join(worth, F.col("entity_id") == F.col("seed")).select("query_id", "chunk_id", (F.col("times") * F.col("w")).alias("s"))
    scores = direct.unionByName(far).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    with scratch.shuffled(edges.sparkSession, parts):
        return scratch.table(scores.withColumn("rank", rank).filter(F.col("rank") <= max_chunks), "related-chunks")


def entity_context(entities: DataFrame, relations: DataFrame, wanted: DataFrame, parts: int = 1) -> DataFrame:
    """H4, rows dealt to ``parts`` partitions at least: ``entity_id, direction, rel_type, other_id, other_name, other_type``; ends that are no entities are left out."""
    other = entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    sides = [
        relations.select(F.col("source_id").alias("entity_id"), F.lit("outgoing").alias("direction"), F.col("type").alias("rel_type"), F.col("target_id").alias("other_id")),
        relations.select(F.col("target_id").alias("entity_id"), F.lit("incoming").alias("direction"), F.col("type").alias("rel_type"), F.col("source_id").alias("other_id")),
    ]
    begun = scratch.dealt(reduce(DataFrame.unionByName, sides), parts, "entity_id").join(scratch.dealt(wanted.select("entity_id"), parts, "entity_id"), "entity_id")
    return scratch.dealt(begun, parts, "other_id").join(scratch.dealt(other, parts, "other_id"), "other_id").select("entity_id", "direction", "rel_type", "other_id", "other_name", "other_type")
