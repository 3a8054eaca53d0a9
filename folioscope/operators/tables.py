"""Markdown tables and the stitching of consecutive ones of equal width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare, split_lines


def piped(md: Column) -> Column:
    """The rows of a Markdown table."""
    return F.filter(F.transform(split_lines(md), bare), lambda x: x.startswith("|"))


def columns(rows: Column) -> Column:
    """C11, of ``piped`` rows: bars of the first row that is no separator, less one; 0 without one."""
    first = F.get(F.filter(rows, lambda x: ~x.contains("---")), F.lit(0))
    return F.coalesce(F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1, F.lit(0))


def _separator(rows: Column) -> Column:
    return F.array_position(F.transform(rows, lambda x: x.contains("---")), F.lit(True)).cast("int")


def data_rows(rows: Column) -> Column:
    """C12, of ``piped`` rows: those after the first separator that are none themselves."""
    at = _separator(rows)
    return F.when(at > 0, F.filter(F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0))), lambda x: ~x.contains("---"))).otherwise(F.array().cast("array<string>"))


def header(rows: Column) -> Column:
    """C12, of ``piped`` rows: those up to and with the first separator."""
    at = _separator(rows)
    return F.array_join(F.when(at > 0, F.slice(rows, 1, at)).otherwise(rows), "\n")


def stitched(tables: DataFrame) -> DataFrame:
    """``doc_id, nth, page, md`` from ``tables (doc_id, ord, page, md)``: runs of equal width become one table.

    A run keeps the first header and page; a table alone keeps its text.
    """
    width = columns(piped(F.col("md")))
    rows = tables.select("doc_id", F.struct("ord", F.col("page").cast("int").alias("page"), "md", width.cast("int").alias("width")).alias("t"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    run = "struct<page:int,width:int,mds:array<string>>"

    def entered(runs: Column, t: Column) -> Column:
        """A table joins the last run or opens one: a run is as long as a document has tables of one width."""
        last = F.element_at(runs, -1)
        joins = (F.size(runs) > 0) & (t["width"] != 0) & (F.get(runs, F.size(runs) - 1)["width"] == t["width"])
        longer = F.struct(last["page"].alias("page"), last["width"].alias("width"), F.array_append(last["mds"], t["md"]).alias("mds")).cast(run)
        own = F.struct(t["page"].alias("page"), t["width"].alias("width"), F.array(t["md"]).alias("mds")).cast(run)
        return F.when(joins, F.array_append(F.slice(runs, 1, F.size(runs) - 1), longer)).otherwise(F.array_append(runs, own))

    runs = rows.select("doc_id", F.posexplode(F.reduce("all", F.array().cast(f"array<{run}>"), entered)).alias("nth", "r")).select("doc_id", "nth", "r.page", "r.mds")
    whole = F.concat(header(piped(F.col("mds")[0])), F.lit("\n"), F.array_join(F.flatten(F.transform("mds", lambda md: data_rows(piped(md)))), "\n"))
    return runs.select("doc_id", (F.col("nth") + 1).alias("nth"), F.coalesce("page", F.lit(1)).alias("page"), F.when(F.size("mds") == 1, F.col("mds")[0]).otherwise(whole).alias("md"))
