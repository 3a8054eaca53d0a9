"""Lookups and upserts of the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .name_index import NameIndex, lookup
from .vectors import search


def by_chunk(entities: DataFrame, chunk_entities: DataFrame, chunks: DataFrame, parts: int = 1) -> DataFrame:
    """G1: entities of the given ``chunk_id``s; rows are dealt to ``parts`` partitions at least."""
    asked, own = (scratch.dealt(df, parts, "chunk_id") for df in (chunks.select("chunk_id"), chunk_entities.select("chunk_id", "entity_id")))
    return scratch.dealt(asked.join(own, "chunk_id"), parts, "entity_id").join(scratch.dealt(entities, parts, "entity_id"), "entity_id")


def by_type(entities: DataFrame, kind: str) -> DataFrame:
    """G2"""
    return entities.filter(F.col("type") == kind)


def by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    """G7"""
    return entities.filter(F.col("entity_id") == entity_id)


def related(entities: DataFrame, relations: DataFrame, start: DataFrame, kind: str | None = None, parts: int = 1) -> DataFrame:
    """Targets one relation away from ``start (entity_id)``, a row per relation; rows are dealt to ``parts`` partitions at least."""
    out = relations if kind is None else relations.filter(F.col("type") == kind)
    out = out.select(F.col("source_id").alias("start_id"), F.col("type").alias("rel_type"), F.col("target_id").alias("entity_id"))
    begun = scratch.dealt(start.select(F.col("entity_id").alias("start_id")), parts, "start_id").join(scratch.dealt(out, parts, "start_id"), "start_id")
    return scratch.dealt(begun, parts, "entity_id").join(scratch.dealt(entities, parts, "entity_id"), "entity_id")


def find(entities: DataFrame, pattern: str, kind: str | None = None, index: NameIndex | None = None) -> DataFrame:
    """Names that hold the pattern, letter case aside; ``_`` and ``%`` in it are wildcards. With the ``index`` of the names few of them are read."""
    out = entities if kind is None else by_type(entities, kind)
    if index is None:
        escaped = pattern.replace("\\", "\\\\")
        return out.filter(F.col("name").ilike(f"%{escaped}%"))
    asked = entities.sparkSession.range(1).select(F.lit(pattern).alias("pattern"))
    # the names are counted: where they are few, entities aren't dealt by name, of which one may have many
    return out.join(scratch.small(lookup(index, asked).select("name"), "found-names"), "name", "left_semi").select(*entities.columns)


def chunks_for(entities: DataFrame, wanted: DataFrame, parts: int = 1) -> DataFrame:
    """G5; rows are dealt to ``parts`` partitions at least."""
    asked, own = (scratch.dealt(df, parts, "entity_id") for df in (wanted.select("entity_id"), entities.select("entity_id", "chunk_ids")))
    return asked.join(own, "entity_id").select("entity_id", F.explode("chunk_ids").alias("chunk_id"))


def find_semantic(vectors: DataFrame, queries: DataFrame, top_k: int = 5, threshold: float = 0.3) -> DataFrame:
    """``query_id, entity_id, score, rank``: cosine with 1e-10 in the denominators, the best ``top_k`` at or above ``threshold``."""
    found = search(vectors.withColumnRenamed("entity_id", "chunk_id"), queries, top_k, threshold, 1e-10)
    return found.withColumnRenamed("chunk_id", "entity_id")


def decoded(entities: DataFrame, schema: str) -> DataFrame:
    """The JSON properties by a schema."""
    return entities.withColumn("properties", F.from_json("properties", schema))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table with the last change of each key in its place."""
    columns = [c for c in table.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))
