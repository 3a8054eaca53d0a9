"""Text expressions shared by the operators; all but the decoding of HTML run inside the JVM."""

from __future__ import annotations

import html

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = "[a-z0-9]+"


def strip(c: Column) -> Column:
    """All white space off both ends, Unicode's too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bare(c: Column) -> Column:
    """``strip`` for a column or a lambda's variable: what starts and ends with a visible ASCII character is taken as it is, without the pattern."""
    seen = lambda x: x.between("!", "~")
    return F.when(seen(F.substring(c, 1, 1)) & seen(F.substring(c, -1, 1)), c).otherwise(strip(c))


def split_lines(c: Column) -> Column:
    """Lines at every line boundary; a break at the end opens no further line."""
    # most texts hold no break but line feeds, which are split at without a pattern
    parts = F.when(c.rlike(RARE_BREAK), F.split(c, LINE_BREAK)).otherwise(F.split(c, "\n"))
    # named once: an expression that a lambda's body repeats is evaluated as often
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)), 0)


def _decoded(values: pa.Array) -> pa.Array:
    """Every HTML character reference of the values that hold an ampersand; all others are passed on as they are."""
    held = pc.fill_null(pc.match_substring(values, "&"), False)
    if not pc.any(held).as_py():
        return values
    return pc.replace_with_mask(values, held, pa.array([html.unescape(x) for x in values.filter(held).to_pylist()], values.type))


def unescape(c: Column) -> Column:
    """Named references, the longest known name first and with or without semicolon, and numbers, with those that are replaced or left out."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return _decoded(values)

    return run(c)


def unescape_each(c: Column) -> Column:
    """``unescape`` for arrays of strings."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, _decoded(lists.flatten()), mask=lists.is_null())

    return run(c)


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of a group in it, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column) -> Column:
    return matches(F.lower(c), TOKEN, 0)


def iso_date(c: Column) -> Column:
    """The first D.M.YYYY as YYYY-MM-DD, null without one."""
    found = F.regexp_extract(c, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 0)
    part = lambda k: F.element_at(F.split(found, r"\."), k)
    return F.when(found != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
