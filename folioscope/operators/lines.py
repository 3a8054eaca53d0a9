"""A document's lines, noise, sections, pages, and section texts with page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare, split_lines, strip

#: Page-break lines, noise lines (page header, US number, page number, empty heading).
PAGE_BREAKS = ("<!-- PB -->", r"<\!-- PB -->")
NOISE = (r"^EP\s+[\d\s]+[A-Z]\d?\s*$", r"^US\s+[\d,]+\s*[A-Z]?\d?\s*$", r"^\d{1,3}\s*$", r"^#{1,6}\s*$")
#: Heading patterns and their sections, in order of precedence.
HEADINGS = (
    (r"(?i)^#{1,3}\s+ABSTRACT", "abstract"),
    (r"(?i)^#{1,3}\s+CLAIMS?", "claims"),
    (r"(?i)^#{1,3}\s+BACKGROUND", "background"),
    (r"(?i)^#{1,3}\s+DETAILED\s+DESCRIPTION", "description"),
    (r"(?i)^#{1,3}\s+DESCRIPTION", "description"),
    (r"(?i)^#{1,3}\s+EXAMPLES?", "examples"),
    (r"(?i)^#{1,3}\s+EMBODIMENTS?", "embodiments"),
    (r"(?i)^#{1,3}\s+BRIEF\s+DESCRIPTION\s+OF.*(?:DRAWING|FIGURE)", "figures"),
    (r"(?i)^#{1,3}\s+SUMMARY", "description"),
    (r"(?i)^#{1,3}\s+FIELD\s+OF", "background"),
)


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line`` of ``docs (doc_id, text)``."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def is_noise(line: Column) -> Column:
    """C1, of a stripped line; blank lines are never noise. Few lines start with a character that noise may start with."""
    # one anchor before the choice: with one in each branch every place of a line is tried
    return F.substring(line, 1, 1).isin(*"EU#0123456789") & line.rlike("^(?:" + "|".join(p.removeprefix("^") for p in NOISE) + ")")


def heading(line: Column) -> Column:
    """The section that a stripped line opens, null if it is no heading; the first pattern wins."""
    out = F.lit(None).cast("string")
    for pattern, section in reversed(HEADINGS):
        out = F.when(line.rlike(pattern), section).otherwise(out)
    return F.when(line.startswith("#"), out)


def located(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line, opens, section, page`` without page breaks and noise."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines(docs).withColumn("bare", bare(F.col("line")))
    # what is told of a line is told before the window, whose rows would else be stripped again for each pattern
    rows = rows.select("doc_id", "pos", "line", F.col("bare").isin(*PAGE_BREAKS).alias("broken"), is_noise(F.col("bare")).alias("noise"), heading(F.col("bare")).alias("opens")).filter("not noise")
    rows = rows.withColumn("page", (1 + F.sum(F.col("broken").cast("int")).over(upto)).cast("int")).withColumn("section", F.coalesce(F.last("opens", ignorenulls=True).over(upto), F.lit("preamble")))
    return rows.filter("not broken").select("doc_id", "pos", "line", "opens", "section", "page")


def outlined(docs: DataFrame) -> DataFrame:
    """C4, C5 within a document's row: ``doc_id, sections``, an array of structs (section, text) in order; nothing is dealt or sorted.

    Lines that break a page or open a section cut the others into runs; a run's lines are joined once.
    """
    rows = docs.select("doc_id", F.transform(split_lines(F.col("text")), lambda x: F.struct(x.alias("line"), bare(x).alias("bare"))).alias("rows"))
    rows = rows.select("doc_id", F.filter("rows", lambda r: ~is_noise(r["bare"])).alias("rows"))
    told = F.transform("rows", lambda r, k: F.struct(k.alias("at"), r["bare"].isin(*PAGE_BREAKS).alias("broken"), heading(r["bare"]).alias("opens")))
    rows = rows.select("doc_id", F.transform("rows", lambda r: r["line"]).alias("rows"), F.filter(told, lambda c: c["broken"] | c["opens"].isNotNull()).alias("cuts"))
    run = "struct<at:int,page:int,section:string>"
    first = F.struct(F.lit(-1).alias("at"), F.lit(1).alias("page"), F.lit("preamble").alias("section")).cast(run)

    def entered(runs: Column, c: Column) -> Column:
        last = F.element_at(runs, -1)
        return F.array_append(runs, F.struct(c["at"].alias("at"), (last["page"] + c["broken"].cast("int")).alias("page"), F.coalesce(c["opens"], last["section"]).alias("section")).cast(run))

    rows = rows.select("doc_id", "rows", F.reduce("cuts", F.array(first).cast(f"array<{run}>"), entered).alias("runs"))
    size = lambda r, k: F.coalesce(F.get("runs", k + 1)["at"], F.size("rows")) - r["at"] - 1
    own = F.transform("runs", lambda r, k: F.struct(r["page"].alias("page"), r["section"].alias("section"), F.slice("rows", r["at"] + 2, size(r, k)).alias("lines")))
    rows = rows.select("doc_id", F.filter(own, lambda r: F.size(r["lines"]) > 0).alias("runs"))
    names = F.array_distinct(F.transform("runs", lambda r: r["section"]))
    rows = rows.select("doc_id", F.transform(names, lambda s: F.struct(s.alias("section"), F.filter("runs", lambda r: r["section"] == s).alias("runs"))).alias("sections"))
    marker = lambda r: F.format_string("<!-- PB:%d -->\n", r["page"])
    text = lambda runs: F.array_join(F.transform(runs, lambda r, k: F.concat(F.when((k > 0) & (F.get(runs, k - 1)["page"] == r["page"]), "").otherwise(marker(r)), F.array_join(r["lines"], "\n"))), "\n")
    whole = F.transform("sections", lambda s: F.struct(s["section"].alias("section"), strip(text(s["runs"])).alias("text")))
    return rows.select("doc_id", F.filter(whole, lambda s: s["text"] != "").alias("sections"))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, ord, section, text``; a marker stands before a section's first line and wherever its page changes."""
    # the outer form, for the other makes a condition on the array, which is asked below all projections: outlines would be made again for each name that they read
    rows = outlined(docs).select("doc_id", F.posexplode_outer("sections").alias("place", "s")).filter("place is not null")
    return rows.select("doc_id", (F.col("place") + 1).alias("ord"), "s.section", "s.text")
