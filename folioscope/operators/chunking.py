"""Sections and tables to chunks with pages, kinds, references and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RARE_BREAK, bare, matches, split_lines

MARKER = r"<!--\s*PB:(\d+)\s*-->"
#: What tags a formula paragraph, and reference patterns with their type, in order.
FORMULA = r"(?iU)Formula\s*\(\d+\)|Equation\s*\(\d+\)|\[\w+\]/\d+"
REFERENCES = (
    (r"(?i)Table\s*(\d+)", "table"),
    (r"(?i)Formula\s*\((\d+)\)", "formula"),
    (r"(?i)FIG\.?\s*(\d+)", "figure"),
    (r"(?i)Figure\s*(\d+)", "figure"),
    (r"(?i)Equation\s*\((\d+)\)", "formula"),
)


#: A line of its own numbered claim, and of a paragraph tag: what opens a block, after white space.
CLAIM, TAG = r"[0-9]+\.[ \t][^\n]*\S", r"\[[0-9]{4}\]"


def _line_blocks(text: Column, start: str) -> Column:
    """A section's text cut before each line that matches ``start``, as structs (blk, block); what stands before the first is block 0."""
    lines = F.when(text.rlike(RARE_BREAK), F.array_join(split_lines(text), "\n")).otherwise(text)
    parts = F.split(lines, rf"(?U)\n(?=[^\S\n]*{start})")
    # asked once a text: what a lambda's body holds is evaluated for each block
    opened = lines.rlike(rf"(?U)\A[^\S\n]*{start}")
    numbered = lambda first: F.transform(parts, lambda x, k: F.struct((k + first).cast("int").alias("blk"), bare(x).alias("block")))
    return F.when(opened, numbered(1)).otherwise(numbered(0))


def _blank_blocks(text: Column) -> Column:
    """A text cut at blank lines."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), bare), lambda x: x != "")
    return F.transform(parts, lambda x, k: F.struct(k.cast("int").alias("blk"), x.alias("block")))


def _exploded(sections: DataFrame, blocks: Column) -> DataFrame:
    return sections.select("doc_id", "ord", "section", F.inline(blocks))


def claims(sections: DataFrame) -> DataFrame:
    """A block per numbered claim."""
    return _exploded(sections, _line_blocks(F.col("text"), CLAIM))


def tagged(sections: DataFrame) -> DataFrame:
    """D3: a block per paragraph tag."""
    return _exploded(sections, _line_blocks(F.col("text"), TAG))


def _paragraphs(text: Column) -> Column:
    return F.when(text.rlike(r"^\[\d{4}\]"), _line_blocks(text, TAG)).otherwise(_blank_blocks(text))


def paragraphs(sections: DataFrame) -> DataFrame:
    """Blocks between blank lines; sections that start with a paragraph tag are cut at the tags."""
    return _exploded(sections, _paragraphs(F.col("text")))


def _paged(blocks: Column) -> Column:
    """Structs (page, content) of a section's blocks: a block's page is its first marker's, else the last one's before it, else 1; markers go, and blocks of nothing else."""
    own = lambda x: F.when(x.contains("<!--"), F.nullif(F.regexp_extract(x, MARKER, 1), F.lit("")).try_cast("int"))
    without = lambda x: F.when(x.contains("<!--"), bare(F.regexp_replace(x, MARKER, ""))).otherwise(x)
    told = F.transform(F.filter(blocks, lambda b: b["block"] != ""), lambda b: F.struct(own(b["block"]).alias("own"), without(b["block"]).alias("without")))
    kind = "array<struct<page:int,content:string>>"
    page = lambda out, x: F.coalesce(x["own"], F.element_at(out, -1)["page"])
    start = F.array(F.struct(F.lit(1).alias("page"), F.lit("").alias("content"))).cast(kind)
    placed = F.reduce(told, start, lambda out, x: F.array_append(out, F.struct(page(out, x).alias("page"), x["without"].alias("content")).cast("struct<page:int,content:string>")))
    clean = lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)
    return F.transform(F.filter(placed, lambda x: x["content"] != ""), lambda x: F.struct(x["page"].alias("page"), clean(x["content"]).alias("content")))


def references(content: Column, doc_id: Column) -> Column:
    """The first of each (type, id) in order of patterns, as structs (raw_text, ref_type, ref_id)."""
    def resolved(pattern: str, kind: str):
        number = lambda x: F.regexp_extract(x, pattern, 1).cast("long")
        ref_id = lambda x: F.concat(doc_id, F.lit(f"_{kind.upper()}_"), F.format_string("%02d", number(x)))
        return lambda x: F.struct(x.alias("raw_text"), F.lit(kind).alias("ref_type"), ref_id(x).alias("ref_id"))

    found = [F.transform(matches(content, pattern), resolved(pattern, kind)) for pattern, kind in REFERENCES]
    every = F.concat(*found)
    empty = F.array().cast("array<struct<raw_text:string,ref_type:string,ref_id:string>>")
    return F.reduce(every, empty, lambda out, x: F.when(F.exists(out, lambda y: y["ref_id"] == x["ref_id"]), out).otherwise(F.array_append(out, x)))


def chunks(sections: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``chunk_id, doc_id, seq, content, section, page, chunk_type``: sections ``(doc_id, ord, section, text)`` in order, then tables."""
    gathered = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section", "text"))).alias("sections"))
    return outlined_chunks(gathered.select("doc_id", F.transform("sections", lambda s: F.struct(s["section"].alias("section"), s["text"].alias("text"))).alias("sections")), tables)


def outlined_chunks(outlines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``chunks`` of ``outlines (doc_id, sections)``: a document is cut, paged and numbered in its row, which is dealt once to meet its tables."""
    piece = "struct<section:string,page:int,content:string,chunk_type:string>"

    def cut(s: Column) -> Column:
        # sections are read once, whatever they are cut at
        blocks = F.when(s["section"] == "claims", _line_blocks(s["text"], CLAIM)).otherwise(_paragraphs(s["text"]))
        kind = F.when(s["section"] == "claims", "claim")
        return F.transform(_paged(blocks), lambda x: F.struct(s["section"].alias("section"), x["page"].alias("page"), x["content"].alias("content"), kind.alias("chunk_type"))).cast(f"array<{piece}>")

    whole = outlines.select("doc_id", F.flatten(F.transform("sections", cut)).alias("pieces"))
    if tables is not None:
        own = F.struct(F.lit("unknown").alias("section"), F.coalesce("page", F.lit(1)).alias("page"), F.col("md").alias("content"), F.lit("table").alias("chunk_type")).cast(piece)
        none = F.lit(None)
        both = whole.select("doc_id", "pieces", none.cast("int").alias("nth"), none.cast(piece).alias("own")).unionByName(tables.select("doc_id", none.cast(f"array<{piece}>").alias("pieces"), "nth", own.alias("own")))
        both = both.groupBy("doc_id").agg(F.collect_list("pieces").alias("texts"), F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", "own")))).alias("found"))
        whole = both.select("doc_id", F.concat(F.flatten("texts"), F.transform("found", lambda t: t["own"])).alias("pieces"))
    # the outer form: no condition on the pieces is then asked below the projections that make them
    rows = whole.select("doc_id", F.posexplode_outer("pieces").alias("seq", "piece")).filter("seq is not null").select("doc_id", "seq", "piece.*")
    formula = (F.col("content").contains("(") | F.col("content").contains("]/")) & F.col("content").rlike(FORMULA)
    kind = F.coalesce("chunk_type", F.when(formula, "formula").otherwise("paragraph"))
    return rows.select(F.format_string("%s_%04d", "doc_id", "seq").alias("chunk_id"), "doc_id", "seq", "content", "section", "page", kind.alias("chunk_type"))


def wire_format(chunks: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Nested rows for export: metadata, references, and the entities of each chunk if given."""
    out = chunks.withColumn("metadata", F.struct("section", "page", F.col("chunk_type").alias("type"))).withColumn("references", references(F.col("content"), F.col("doc_id")))
    if entities is None:
        return out.select("chunk_id", "doc_id", "content", "metadata", "references")
    own = entities.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("extractor", "k", "entity_id", "type", "name", "properties"))).alias("entities"))
    return out.join(own, "chunk_id", "left").select("chunk_id", "doc_id", "content", "metadata", "references", "entities")
