"""HTML references, the vocabulary automaton, and what a session holds, against plain Python."""

import html
import html.entities
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import unescape, unescape_each
from folioscope.operators import automaton, entities
from folioscope.plans import catalogue
from folioscope.sources import scratch
from folioscope.sources.vocabulary import DEFAULT


def test_references_are_decoded_as_in_python(spark):
    rng = random.Random(3)
    names = list(html.entities.html5)
    texts = [f"&{n}{rest}" for n in names for rest in ("", " ", "x", ";")]
    texts += [f"&#{n};" for n in (0, 1, 9, 13, 31, 127, 128, 150, 159, 0xD800, 0xFDD0, 0xFFFF, 0x10FFFF, 0x110000, 10**20)] + ["&#x80", "&#XfFz", "&#;", "&#x;", "&", "&&amp;&", "&amp;lt;"]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "1", "f", "amp", "not", "in", "é", " ", "lt"]) for _ in range(12)) for _ in range(500)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(-1, None), (-2, "plain")]
    df = spark.createDataFrame(rows, "k int, x string")
    assert {r.k: r.y for r in df.select("k", unescape(F.col("x")).alias("y")).collect()} == {k: x and html.unescape(x) for k, x in rows}
    lists = [(0, ["&lt;", None, "a"]), (1, []), (2, None), (3, ["&Auml", "&auml;&#33;"])]
    got = spark.createDataFrame(lists, "k int, x array<string>").repartition(1).select("k", unescape_each(F.col("x")).alias("y")).collect()
    assert {r.k: r.y for r in got} == {0: ["<", None, "a"], 1: [], 2: None, 3: ["Ä", "ä!"]}


def brute(vocabulary, text):
    """The rule of each kind, one alias after another."""
    low, out = text.lower(), {}
    for kind in ("properties", "processes", "applications", "materials"):
        for canon, aliases in vocabulary[kind].items():
            for alias in aliases:
                inside = alias.lower() in low if kind in automaton.INSIDE else re.search(rf"\b{re.escape(alias.lower())}\b", low)
                if inside:
                    out.setdefault(kind, []).append((canon, alias))
                    break
    for kind in ("problems", "solutions"):
        for phrase in vocabulary[kind]:
            if phrase in low:
                at = low.index(phrase)
                before, after = text[:at], text[at:]
                whole = before.rpartition(".")[2] + (after.partition(".")[0] + "." if "." in after else after)
                out[kind] = [(phrase, whole.strip()[:300])]
                break
    spans, found = set(), []
    for symbol in vocabulary["elements"]:
        for pattern, a, b, u in automaton.COMPOSITION:
            for m in re.finditer(pattern.replace("{symbol}", re.escape(symbol)), text, re.IGNORECASE):
                if m.span() not in spans:
                    spans.add(m.span())
                    found.append((symbol, float(m[a]), float(m[b]) if b else None, m[u]))
    return out, found


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [a for kind in ("properties", "processes", "applications", "materials") for aliases in DEFAULT[kind].values() for a in aliases]
    words += [*DEFAULT["problems"], *DEFAULT["solutions"], *DEFAULT["elements"], "Si: 2.5%", "2% to 3% by mass of Mn", "0.5 mass% or less of C", "Cr 1 - 2 wt%", "s", "-", ".", "_", "(", "EVs", "İ", "ß", "10%", "of", "by mass", "at 850 °C", "of 300 MPa", "N 3%", "al2%"]
    for _ in range(n):
        yield "".join(rng.choice(words) + rng.choice([" ", " ", "", ".", "-", "\n"]) for _ in range(rng.randrange(14)))


def test_automaton_finds_what_each_alias_would():
    find = automaton.Vocabulary(DEFAULT)
    for text in texts(4000):
        expected, composition = brute(DEFAULT, text)
        got = find(text)
        for kind in (*automaton.INSIDE, *automaton.ALONE):
            assert [(x["canon"], x["alias"]) for x in got[kind]] == expected.get(kind, []), (kind, text)
        for kind in automaton.PHRASES:
            assert [(x["phrase"], x["sentence"]) for x in got[kind]] == expected.get(kind, []), (kind, text)
        assert [(x["symbol"], x["low"], x["high"], x["unit"]) for x in got["composition"]] == composition, text
        for x in got["properties"]:
            m = re.search(re.escape(x["alias"]) + automaton.MEASURE, text, re.IGNORECASE)
            assert (x["value"], x["unit"]) == ((m[1], m[2]) if m else (None, None))
        for x in got["processes"]:
            m = re.search(re.escape(x["alias"]) + automaton.DEGREES, text, re.IGNORECASE)
            assert x["degrees"] == (m and m[1])


def test_automaton_of_odd_vocabularies():
    none = automaton.Vocabulary({})
    assert none("core loss 5%") == {name: [] for name in none("")} and none(None) is None
    odd = automaton.Vocabulary({"properties": {"all": [""], "case": ["ABC", "b"]}, "materials": {"none": [""], "marks": ["+x+"]}, "problems": ["Upper", "low"]})
    got = odd("xabcx +x+ b. The Upper low.")
    assert [(x["canon"], x["alias"]) for x in got["properties"]] == [("all", ""), ("case", "ABC")]
    # between a space and a plus there is no boundary of a word
    assert got["materials"] == [] and [x["canon"] for x in odd("a+x+b")["materials"]] == ["marks"]
    # phrases are looked for as they are written in the lower-cased text
    assert [x["phrase"] for x in got["problems"]] == ["low"]


def test_a_vocabulary_of_a_hundred_thousand_aliases(spark):
    words = {f"canon{i}": [f"alias {i} x", f"other{i}"] for i in range(50_000)}
    vocabulary = DEFAULT | {"properties": words, "materials": {f"m{i}": [f"steel {i}"] for i in range(20_000)}}
    rows = spark.createDataFrame([("c0", "d", 0, "Alias 77 X of 5 MPa, OTHER49999 and steel 12, steel 123."), ("c1", "d", 1, None), ("c2", "d", 2, "")], "chunk_id string, doc_id string, seq int, content string")
    found = {(r.type, r.name): r.properties for r in entities.extracted(rows, vocabulary).collect()}
    assert set(found) == {("property", "canon77"), ("property", "canon49999"), ("material", "m12"), ("material", "m123")} | {("property", f"canon{k}") for k in (4, 49, 499, 4999) if f"other{k}" in "other49999"}
    assert json.loads(found["property", "canon77"]) == {"alias": "alias 77 x", "value": 5.0, "unit": "MPa"}
    with pytest.raises(ValueError, match="beyond"):
        automaton.hits(spark, {"problems": ["x" * automaton.BYTES]}, F.col("content"))


def test_numbers_that_no_column_holds_are_null(spark):
    rows = spark.createDataFrame([("c0", "d", 0, "annealed at 99999999999 °C, core loss of ٣ T")], "chunk_id string, doc_id string, seq int, content string")
    found = {r.name: json.loads(r.properties) for r in entities.extracted(rows).collect()}
    assert "temperature" not in found["annealing"] and found["core_loss"]["unit"] == "T" and "value" not in found["core_loss"]


def test_queries_run_again_after_release(spark):
    sf = "/root/testdata/sf0.001"
    before = catalogue.QUERIES["term_idf"](spark, sf).count()
    entities_before = catalogue.QUERIES["entities_by_type"](spark, sf).count()
    scratch.release(spark)
    assert catalogue.QUERIES["term_idf"](spark, sf).count() == before
    assert catalogue.QUERIES["entities_by_type"](spark, sf).count() == entities_before


def test_small_tables_are_counted_in_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    rows = spark.range(100).select("id", F.expr("repeat('x', 1000)").alias("x"), F.lit(None).cast("string").alias("y"), F.array(F.lit("z")).alias("a.b"))
    assert hinted(scratch.small(rows, "some")) and not hinted(scratch.small(rows, "some", rows=99)) and not hinted(scratch.small(rows, "some", size=50_000))
    assert hinted(scratch.small(rows.limit(0), "none"))
