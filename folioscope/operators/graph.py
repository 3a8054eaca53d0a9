"""The knowledge graph of mentions: merged entities and relations by co-occurrence.

``seq`` orders chunks within a document and documents go by id, which fixes what first
and last mean. Relations whose id repeats keep their first or last row by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches
from ..sources import scratch

CONTEXT = 200
#: Fixed value: how a text names a table.
LABEL = r"(?i)Table\s*(\d+)"
FIRST_WINS = ("mentions", "used_for", "cites", "addresses_problem", "invented_by", "assignee_of")


def merged(mentions: DataFrame) -> DataFrame:
    """``entity_id, type, name, properties, doc_id, chunk_ids``: the first mention decides, chunks are united in order."""
    order = F.struct("doc_id", "seq", "extractor", "k")
    first = F.min_by(F.struct("type", "name", "properties", "doc_id"), order).alias("first")
    # sorts compare numbers: ids of one kind start alike
    out = mentions.groupBy(F.xxhash64("entity_id").alias("hash"), "entity_id").agg(first, F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
    return out.select("entity_id", "first.*", "chunk_ids")


def chunk_entities(entities: DataFrame) -> DataFrame:
    """``chunk_id, entity_id, type, name, doc_id, properties``"""
    return entities.select(F.explode("chunk_ids").alias("chunk_id"), "entity_id", "type", "name", "doc_id", "properties")


def labels(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, seq, label``: a row for each label in a table chunk."""
    return chunks.filter("chunk_type = 'table'").select("chunk_id", "doc_id", "seq", F.explode(matches(F.col("content"), LABEL, 1)).alias("label"))


def table_labels(rows: DataFrame, scope: str = "global") -> DataFrame:
    """``label, doc_id, table_chunk``: the first of ``labels`` that names a label, of all documents or of each."""
    keys = ["label"] if scope == "global" else ["label", "doc_id"]
    first = rows.groupBy(*keys).agg(F.min_by("chunk_id", F.struct("doc_id", "seq")).alias("table_chunk"))
    return first if scope == "document" else first.withColumn("doc_id", F.lit(None).cast("string"))


RELATION = "array<struct<rel_id:string,type:string,source_id:string,target_id:string,properties:string,doc_id:string>>"


def relations(chunks: DataFrame, entities: DataFrame, scope: str = "global") -> DataFrame:
    """``rel_id, type, source_id, target_id, properties, doc_id, chunk_id, seq`` with repeated ids.

    Only labels of tables are joined across chunks; the rest is ``within``.
    """
    return within(chunks, entities).unionByName(mentioned(label_uses(chunks), table_labels(labels(chunks), scope), scope))


def within(chunks: DataFrame, entities: DataFrame, told: bool = True) -> DataFrame:
    """The relations that one chunk gives; their properties are null unless ``told``.

    A chunk's entities are gathered once (they are as many as its text names), and all
    relations within it are expressions over that array.
    """
    degrees = F.get_json_object("properties", "$.temperature").cast("int")
    gathered = chunk_entities(entities).groupBy("chunk_id").agg(F.collect_list(F.struct("entity_id", "type", F.col("doc_id").alias("own"), degrees.alias("degrees"))).alias("all"))
    nothing = F.lit(None).cast("string")
    rows = chunks.select("chunk_id", "doc_id", "seq", "chunk_type", (F.left("content", F.lit(CONTEXT)) if told else nothing).alias("context")).join(gathered, "chunk_id")
    quote, none, doc, chunk = F.to_json(F.struct("context")) if told else nothing, F.lit("{}"), F.col("doc_id"), F.col("chunk_id")
    typed = lambda *kinds: F.filter("all", lambda x: x["type"].isin(*kinds))
    join = lambda prefix, *parts: F.concat(F.lit(prefix), F.concat_ws("_", *parts))

    def rel(kind: str, rel_id: Column, source: Column, target: Column, properties: Column, of: Column) -> Column:
        return F.struct(rel_id.alias("rel_id"), F.lit(kind).alias("type"), source.alias("source_id"), target.alias("target_id"), properties.alias("properties"), of.alias("doc_id"))

    def each(items: Column, make) -> Column:
        return F.transform(items, make).cast(RELATION)

    def pairs(kind: str, prefix: str, left: Column, right: Column) -> Column:
        one = lambda a: F.transform(right, lambda b: rel(kind, join(prefix, a["entity_id"], b["entity_id"]), a["entity_id"], b["entity_id"], quote, a["own"]))
        return F.flatten(F.transform(left, one)).cast(RELATION)

    def only(condition: Column, items: Column) -> Column:
        return F.when(condition, items).otherwise(F.array().cast(items_type))

    items_type = "array<struct<entity_id:string,type:string,own:string,degrees:int>>"
    value = lambda x: nothing if not told else F.to_json(F.struct(F.lit("temperature").alias("parameter_type"), x["degrees"].alias("value"), F.lit("°C").alias("unit")))
    named, alone = doc != "", F.size(typed("material")) == 0
    parts = [
        each(F.col("all"), lambda x: rel("described_in", join("described_", x["entity_id"], chunk), x["entity_id"], chunk, none, x["own"])),
        pairs("affects", "affects_", typed("chemical_element"), typed("property")),
        each(F.filter(typed("process"), lambda x: x["degrees"] != 0), lambda x: rel("requires", F.concat(F.lit("requires_"), x["entity_id"], F.lit("_temp")), x["entity_id"], F.concat(x["entity_id"], F.lit("_temp_param")), value(x), x["own"])),
        each(typed("table", "formula"), lambda x: rel("references", join("ref_", chunk, x["entity_id"]), chunk, x["entity_id"], none, doc)),
        each(only(F.col("chunk_type") == "table", typed("property")), lambda x: rel("measured_in", join("measured_", x["entity_id"], chunk), x["entity_id"], chunk, F.lit('{"table_type":"data_table"}'), x["own"])),
        pairs("used_for", "used_for_", typed("material"), typed("application")),
        each(typed("patent_reference"), lambda x: rel("cites", join("cites_", doc, x["entity_id"]), doc, x["entity_id"], none, doc)),
        pairs("addresses_problem", "addresses_", typed("material"), typed("problem")),
        each(only(named & alone, typed("problem")), lambda x: rel("addresses_problem", join("addresses_", doc, x["entity_id"]), doc, x["entity_id"], quote, doc)),
        each(only(named, typed("inventor")), lambda x: rel("invented_by", join("invented_by_", doc, x["entity_id"]), doc, x["entity_id"], none, doc)),
        each(only(named, typed("assignee")), lambda x: rel("assignee_of", join("assignee_of_", x["entity_id"], doc), x["entity_id"], doc, none, doc)),
    ]
    return rows.select("chunk_id", "seq", F.inline(F.concat(*parts)))


def label_uses(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, seq, label``: a row for each label that a chunk of text names."""
    return chunks.filter("chunk_type <> 'table'").select("chunk_id", "doc_id", "seq", F.explode(matches(F.col("content"), LABEL, 1)).alias("label"))


def mentioned(uses: DataFrame, labels: DataFrame, scope: str = "global") -> DataFrame:
    """F8: from chunks to the tables that they name; the labels are broadcast only if they are counted to be few."""
    known = scratch.small(labels.withColumnRenamed("doc_id", "label_doc").withColumnRenamed("label", "label_named"), "labels")
    on = F.col("label") == F.col("label_named")
    out = uses.join(known, on if scope == "global" else on & (F.col("doc_id") == F.col("label_doc")))
    rel_id = F.concat(F.lit("mentions_"), F.concat_ws("_", "chunk_id", "table_chunk"))
    return out.select("chunk_id", "seq", rel_id.alias("rel_id"), F.lit("mentions").alias("type"), F.col("chunk_id").alias("source_id"), F.col("table_chunk").alias("target_id"), F.lit("{}").alias("properties"), "doc_id")


def stored(relations: DataFrame) -> DataFrame:
    """a row per id: the first chunk's for the kinds that check ids, the last one's for the others."""
    return _picked(relations, "type", "source_id", "target_id", "properties", "doc_id", "chunk_id")


def _picked(relations: DataFrame, *columns: str) -> DataFrame:
    """``rel_id`` and some columns of the row that an id keeps."""
    relations = relations.select("rel_id", "seq", *dict.fromkeys(["type", "doc_id", *columns]))
    row, order = F.struct(*columns), F.struct("doc_id", "seq")
    # an id starts with its kind's name, so rows of one id are of kinds that agree; each row is held for the one place that may take it
    wins = F.col("type").isin(*FIRST_WINS)
    only = lambda which, x: F.when(which, x)
    # few ids repeat in a task, so rows are dealt as they are and sorted once, not before and after
    dealt = relations.withColumn("hash", F.xxhash64("rel_id")).repartition("hash")
    picked = dealt.groupBy("hash", "rel_id").agg(F.min_by(only(wins, row), only(wins, order)).alias("first"), F.max_by(only(~wins, row), only(~wins, order)).alias("last"))
    return picked.select("rel_id", F.coalesce("first", "last").alias("r")).select("rel_id", "r.*")


def edges_within(chunks: DataFrame, entities: DataFrame, scope: str = "global") -> DataFrame:
    """``src, dst`` of the ``relations`` that are ``stored``, without their properties; few edges are parallel, and these stay.

    For who asks for no relation but the way they lead.
    """
    every = within(chunks, entities, told=False).unionByName(mentioned(label_uses(chunks), table_labels(labels(chunks), scope), scope))
    return _picked(every, "source_id", "target_id").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def edges(relations: DataFrame) -> DataFrame:
    """``src, dst``, parallel edges as one."""
    return relations.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
