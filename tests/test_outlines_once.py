"""Outlines are made once: no condition on what they give is asked below the projections that make it."""

from __future__ import annotations

from folioscope.operators import chunking, lines, metadata

TEXT = "(21) Application number: 7\n(71) Applicant: Works AG\n## ABSTRACT\na\n<!-- PB -->\nb\n## CLAIMS\n1. A sheet.\n2. Another."


def documents(spark):
    return spark.createDataFrame([("d", "d_B1.pdf", TEXT), ("e", "e.pdf", ""), ("f", "f.pdf", None)], "doc_id string, filename string, text string")


def asked(df) -> list[str]:
    """The conditions of a plan, a line each."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]


def reads_text(df) -> bool:
    return any("split" in x or "reduce" in x or "transform" in x or "filter(" in x for x in asked(df))


def test_sections_ask_nothing_of_an_outline(spark):
    out = lines.sections(documents(spark))
    assert not reads_text(out)
    assert [tuple(r) for r in out.orderBy("ord").collect()] == [("d", 1, "preamble", "<!-- PB:1 -->\n(21) Application number: 7\n(71) Applicant: Works AG"), ("d", 2, "abstract", "<!-- PB:1 -->\na\n<!-- PB:2 -->\nb"), ("d", 3, "claims", "<!-- PB:2 -->\n1. A sheet.\n2. Another.")]


def test_chunks_without_tables_ask_nothing_of_their_pieces(spark):
    out = chunking.outlined_chunks(lines.outlined(documents(spark)))
    assert not reads_text(out)
    assert [(r.seq, r.page, r.content) for r in out.orderBy("seq").collect()] == [(0, 1, "(21) Application number: 7\n(71) Applicant: Works AG"), (1, 1, "a\n\nb"), (2, 2, "1. A sheet."), (3, 2, "2. Another.")]


def test_bibliographic_fields_ask_nothing_of_an_outline(spark):
    out = metadata.fields(documents(spark))
    assert not reads_text(out)
    assert [(r.doc_id, r.application_number, r.applicant) for r in out.collect()] == [("d", "7", "Works AG")]


def test_assembled_documents_ask_nothing_of_an_outline(spark):
    out = metadata.assembled(documents(spark))
    assert not reads_text(out)
    assert {r.doc_id: (len(r.sections), r.metadata.applicant) for r in out.collect()} == {"d": (3, "Works AG"), "e": (0, None), "f": (0, None)}
