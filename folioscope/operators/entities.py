"""Typed entity mentions of chunks.

What a vocabulary decides comes from one automaton in Arrow batches (``automaton``); all
other extractors are column expressions over the chunk text. Each gives an array of
mentions, so a chunk is read once and nothing is joined.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches, strip
from ..sources.vocabulary import DEFAULT
from .automaton import COMPOSITION, DEGREES, MEASURE, hits

MENTION = "array<struct<extractor:int,k:int,entity_id:string,type:string,name:string,properties:string>>"
EXTRACTORS = ("elements", "properties", "processes", "references", "samples", "cited", "inventors", "assignees", "applications", "materials", "patdocs", "problems", "solutions")
#: The extractors that a vocabulary decides.
VOCABULARY = {"elements", "properties", "processes", "applications", "materials", "problems", "solutions"}
#: The patterns of references, samples, citations and people.
REFERENCES = (("table", r"(?i)Table\s*(\d+)", "Table "), ("formula", r"(?i)Formula\s*\((\d+)\)", "Formula "), ("figure", r"(?i)(?:FIG\.?|Figure)\s*(\d+)", "Figure "))
CITED = r"(?iU)(?:US|EP|WO|JP|CN|KR|DE|GB|FR)\s*[\d,./\-]{4,}(?:\s*[AB]\d)?\b"
PATDOC = r"(?i)Patent\s+(?:Document|Literature|Lit\.?)\s+(\d+)"
PEOPLE = {"inventors": r"[Ii]nventor(?:s)?\s*[:;]\s*(.+?)(?:\n|$)", "assignees": r"(?:[Aa]ssignee|[Aa]pplicant)(?:s)?\s*[:;]\s*(.+?)(?:\n|$)"}
SAMPLE = r"(?:Sample|Symbol|Material)\s+([a-zA-Z]\d+)"


def _mentions(extractor: str, items: Column, entity_id, kind: str, name, properties) -> Column:
    """An array of mentions from an array of items; the callables get (item, place)."""
    number = EXTRACTORS.index(extractor)
    one = lambda x, k: F.struct(
        F.lit(number).alias("extractor"), k.cast("int").alias("k"), entity_id(x, k).alias("entity_id"), F.lit(kind).alias("type"), name(x, k).alias("name"), properties(x, k).alias("properties")
    )
    return F.coalesce(F.transform(items, one), F.array().cast(MENTION)).cast(MENTION)


def _id(*parts) -> Column:
    return F.concat(F.col("doc_id"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def elements(items: Column) -> Column:
    ranged = lambda x: x["high"].isNotNull()
    number = EXTRACTORS.index("elements")
    one = lambda x, k: F.struct(
        F.lit(number).alias("extractor"), k.cast("int").alias("k"),
        F.concat(F.col("doc_id"), F.lit("_"), x["symbol"], F.when(ranged(x), "_range_").otherwise("_"), k.cast("string")).alias("entity_id"),
        F.when(ranged(x), "composition_range").otherwise("chemical_element").alias("type"), F.when(ranged(x), F.concat(x["symbol"], F.lit("_range"))).otherwise(x["symbol"]).alias("name"),
        F.when(ranged(x), F.to_json(F.struct(x["symbol"].alias("element"), x["low"].alias("min_val"), x["high"].alias("max_val"), F.lit("%").alias("unit")))).otherwise(F.to_json(F.struct(x["full"].alias("full_name"), x["low"].alias("value"), x["unit"].alias("unit")))).alias("properties"),
    )
    return F.coalesce(F.transform(items, one), F.array().cast(MENTION)).cast(MENTION)


def _vocabulary(extractor: str, items: Column, kind: str, told) -> Column:
    """Per canonical id the first alias that the text holds; ``told(item)`` are its properties."""
    return _mentions(extractor, items, lambda x, k: _id("_", x["canon"], "_", k.cast("string")), kind, lambda x, k: x["canon"], lambda x, k: F.to_json(told(x)))


def properties(items: Column) -> Column:
    return _vocabulary("properties", items, "property", lambda x: F.struct(x["alias"].alias("alias"), x["value"].try_cast("double").alias("value"), x["unit"].alias("unit")))


def processes(items: Column) -> Column:
    unit = lambda x: F.when(x["degrees"].isNotNull(), "°C")
    return _vocabulary("processes", items, "process", lambda x: F.struct(x["alias"].alias("alias"), x["degrees"].try_cast("int").alias("temperature"), unit(x).alias("temperature_unit")))


def references() -> Column:
    """E8"""
    out = []
    for kind, pattern, label in REFERENCES:
        numbers = matches(F.col("content"), pattern, 1)
        out.append(_mentions("references", numbers, lambda x, k, t=kind: _id(f"_{t}_", x), kind, lambda x, k, t=label: F.concat(F.lit(t), x), lambda x, k, t=kind: F.to_json(F.struct(x.cast("long").alias(f"{t}_number")))))
    return F.concat(*out)


def samples() -> Column:
    """E9"""
    return _mentions("samples", matches(F.col("content"), SAMPLE, 1), lambda x, k: _id("_sample_", x), "sample", lambda x, k: F.concat(F.lit("Sample "), x), lambda x, k: F.to_json(F.struct(x.alias("sample_id"))))


def cited() -> Column:
    """Once per number without spaces and commas, the first spelling."""
    plain = lambda x: F.regexp_replace(x, "[ ,]", "")
    raw = F.transform(matches(F.col("content"), CITED), lambda x: F.struct(strip(x).alias("raw"), plain(strip(x)).alias("norm")))
    return _mentions("cited", _firsts(raw, "norm", "raw:string,norm:string"), lambda x, k: _id("_cited_", x["norm"]), "patent_reference", lambda x, k: x["raw"], lambda x, k: F.to_json(F.struct(x["norm"].alias("normalized"))))


def patdocs() -> Column:
    """E11"""
    return _mentions("patdocs", F.array_distinct(matches(F.col("content"), PATDOC, 1)), lambda x, k: _id("_patdoc_", x), "patent_doc_reference", lambda x, k: F.concat(F.lit("Patent Document "), x), lambda x, k: F.to_json(F.struct(x.cast("long").alias("doc_number"))))


def _firsts(items: Column, key: str, fields: str) -> Column:
    empty = F.array().cast(f"array<struct<{fields}>>")
    return F.reduce(items, empty, lambda out, x: F.when(F.exists(out, lambda y: y[key] == x[key]), out).otherwise(F.array_append(out, x)))


def people(which: str) -> Column:
    """E12"""
    one = which[:-1]
    names = F.flatten(F.transform(matches(F.col("content"), PEOPLE[which], 1), lambda x: F.split(x, "[;,]")))
    names = F.filter(F.transform(names, strip), lambda x: F.length(x) >= 3)
    return _mentions(which, names, lambda x, k: _id(f"_{one}_", F.replace(F.lower(x), F.lit(" "), F.lit("_"))), one, lambda x, k: x, lambda x, k: F.lit("{}"))


def worded(which: str, items: Column) -> Column:
    """Canonical ids with an alias in the text as whole words; the first alias counts."""
    kind, label = {"applications": ("application", "_app_"), "materials": ("material", "_material_")}[which]
    return _mentions(which, items, lambda x, k: _id(label, x["canon"]), kind, lambda x, k: x["canon"], lambda x, k: F.to_json(F.struct(x["alias"].alias("matched_alias"))))


def triggered(which: str, items: Column) -> Column:
    """The sentence of the first phrase in the list that the text holds; one a chunk."""
    kind = which[:-1]
    label = (lambda x: F.left(F.replace(x, F.lit(" "), F.lit("_")), F.lit(20))) if which == "solutions" else (lambda x: x)
    return _mentions(which, F.filter(items, lambda x: x["sentence"] != ""), lambda x, k: _id(f"_{kind}_0_", label(x["phrase"])), kind, lambda x, k: x["sentence"], lambda x, k: F.to_json(F.struct(x["phrase"].alias("trigger_phrase"))))


@lru_cache(maxsize=8)
def _expressions(application: str, vocabulary: str, only: tuple[str, ...]) -> tuple[Column | None, Column]:
    """What the automaton finds in a text, if it is asked, and the mentions by some extractors, for a vocabulary as JSON: many calls to the JVM, so made once a session."""
    of = lambda name: F.col("hits")[name]
    made = {
        "elements": lambda: elements(of("composition")), "properties": lambda: properties(of("properties")), "processes": lambda: processes(of("processes")), "references": references, "samples": samples,
        "cited": cited, "inventors": lambda: people("inventors"), "assignees": lambda: people("assignees"), "applications": lambda: worded("applications", of("applications")),
        "materials": lambda: worded("materials", of("materials")), "patdocs": patdocs, "problems": lambda: triggered("problems", of("problems")), "solutions": lambda: triggered("solutions", of("solutions")),
    }
    words = {kind: own for kind, own in json.loads(vocabulary).items() if kind in only}
    told = hits(SparkSession.active(), words, F.col("content")) if set(only) & VOCABULARY else None
    return told, F.concat(*[make() for name, make in made.items() if name in only])


def extracted(chunks: DataFrame, vocabulary: dict = DEFAULT, external: DataFrame | None = None, only=EXTRACTORS) -> DataFrame:
    """``chunk_id, doc_id, seq, extractor, k, entity_id, type, name, properties`` of every mention, or of those by some extractors.

    ``external`` (E2) holds mentions of an outside model in the same columns; they come first.
    """
    found, every = _expressions(chunks.sparkSession.sparkContext.applicationId, json.dumps(vocabulary), tuple(only))
    rows = chunks.select("chunk_id", "doc_id", "seq", "content", *([] if found is None else [found.alias("hits")]))
    out = rows.select("chunk_id", "doc_id", "seq", F.inline(every))
    return out if external is None else external.select(*out.columns).unionByName(out)


#: The lists in a model's answer, those of measurements and those of names.
MODEL_LISTS = "compositions array<struct<element:string,min_val:double,max_val:double,unit:string>>, properties array<struct<name:string,value:double,unit:string,condition:string>>, processes array<struct<name:string,temperature:double,duration:string,parameters:map<string,string>>>"
MODEL_NAMES = ("inventors", "assignees", "cited_patents", "applications", "materials", "problems", "solutions")
MODEL_SCHEMA = f"{MODEL_LISTS}, patent_meta struct<{','.join(f'{x}:array<string>' for x in MODEL_NAMES)}>"


def from_model(answers: DataFrame) -> DataFrame:
    """Mentions from a model's JSON answers (``chunk_id, doc_id, seq, answer``): three lists of measurements and seven of names; what doesn't parse gives none.

    An id holds the place among all mentions of the answer, or the name where that tells
    them apart, so that names met again are one entity.
    """
    parsed = answers.withColumn("a", F.from_json("answer", MODEL_SCHEMA))
    listed = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    spaced = lambda x: F.replace(x, F.lit(" "), F.lit("_"))
    source = F.lit("llm").alias("source")

    def mention(items: Column, kind: str, name, entity_id, properties) -> Column:
        one = lambda x: F.struct(entity_id(x).alias("entity_id"), F.lit(kind).alias("type"), name(x).alias("name"), properties(x).alias("properties"))
        return F.transform(items, one)

    def measured(field: str, kind: str, key: str, told) -> Column:
        return mention(listed(F.col("a")[field], dict(parsed.select(f"a.{field}").dtypes)[field]), kind, lambda x: x[key], lambda x: x[key], told)

    def named(field: str, kind: str, label: str | None, norm=strip, in_id=spaced) -> Column:
        items = F.transform(listed(F.col("a.patent_meta")[field], "array<string>"), norm)
        entity_id = (lambda x: _id(f"_{label}_", in_id(x))) if label else (lambda x: F.lit(None).cast("string"))
        return mention(items, kind, lambda x: x, entity_id, lambda x: F.to_json(F.struct(source)))

    low = lambda x: F.lower(strip(x))
    more = lambda x: F.to_json(F.map_concat(
        F.map_filter(F.create_map(F.lit("temperature"), x["temperature"].cast("string"), F.lit("duration"), x["duration"]), lambda k, v: v.isNotNull()),
        F.map_filter(F.coalesce(x["parameters"], F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("temperature", "duration", "source")),
        F.create_map(F.lit("source"), F.lit("llm")),
    ))
    every = F.concat(
        measured("compositions", "chemical_element", "element", lambda x: F.to_json(F.struct(x["min_val"].alias("min_val"), x["max_val"].alias("max_val"), x["unit"].alias("unit"), source))),
        measured("properties", "property", "name", lambda x: F.to_json(F.struct(x["value"].alias("value"), x["unit"].alias("unit"), x["condition"].alias("condition"), source))),
        measured("processes", "process", "name", more),
        named("inventors", "inventor", "inventor", in_id=lambda x: spaced(F.lower(x))), named("assignees", "assignee", "assignee", in_id=lambda x: spaced(F.lower(x))),
        named("cited_patents", "patent_reference", "cited", in_id=lambda x: F.replace(x, F.lit(" "), F.lit(""))),
        named("applications", "application", "app", low), named("materials", "material", "material", low), named("problems", "problem", None), named("solutions", "solution", None),
    )
    place = lambda k: k.cast("string")
    entity_id = lambda x, k: F.when(x["type"].isin("chemical_element", "property", "process"), F.concat(F.col("doc_id"), F.lit("_"), x["name"], F.lit("_llm_"), place(k))).when(x["type"].isin("problem", "solution"), F.concat(F.col("doc_id"), F.lit("_"), x["type"], F.lit("_"), place(k))).otherwise(x["entity_id"])
    numbered = F.transform(every, lambda x, k: F.struct(F.lit(-1).alias("extractor"), k.cast("int").alias("k"), entity_id(x, k).alias("entity_id"), x["type"].alias("type"), x["name"].alias("name"), x["properties"].alias("properties"))).cast(MENTION)
    return parsed.select("chunk_id", "doc_id", "seq", F.inline(F.coalesce(numbered, F.array().cast(MENTION))))
