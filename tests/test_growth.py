"""What keeps stages small on large tables."""

from __future__ import annotations

from folioscope.functions import text
from folioscope.operators import bm25, chunking, graph, graph_search, metadata, name_index, store, traverse
from folioscope.plans import ingest
from folioscope.sources import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_who_reads_chunks_makes_no_graph(spark):
    made = []
    docs = spark.createDataFrame([("d", "## ABSTRACT\nStainless steel with 2 % of Si.\n## CLAIMS\n1. A sheet.\n2. Another.")], "doc_id string, text string")
    c = ingest.ingested(docs, keep=lambda df: made.append(df) or df)
    assert made == [] and c.chunks.count() == 3 and len(made) == 1
    assert c.chunks is c.chunks and c.mentions.count() and len(made) == 2


def test_sections_are_read_once_for_all_kinds_of_blocks(spark, tmp_path):
    rows = [("d", 1, "claims", "of\n 1. A\nb\n2.\n3. \n4. C"), ("d", 2, "text", "a\n\n \nb"), ("d", 3, "text", "[0001] x\ny\n [0002]z\n[12] w")]
    spark.createDataFrame(rows, "doc_id string, ord int, section string, text string").write.parquet(str(tmp_path / "s"))
    sections = spark.read.parquet(str(tmp_path / "s"))
    out = chunking.chunks(sections)
    assert plan(out).count("Relation [") == 1
    assert [r.content for r in out.orderBy("seq").collect()] == ["of", "1. A\nb\n2.\n3.", "4. C", "a", "b", "[0001] x\ny", "[0002]z\n[12] w"]
    assert [tuple(r) for r in chunking.claims(sections.filter("ord = 1")).select("blk", "block").collect()] == [(0, "of"), (1, "1. A\nb\n2.\n3."), (2, "4. C")]


def test_blocks_of_chunks_and_queries_give_the_ranks_of_a_plain_scan(spark, monkeypatch):
    words = lambda i: " ".join(["the"] * (i % 3) + [f"w{i % 5}", f"v{i % 7}"])
    chunks = spark.createDataFrame([(f"c{i:03d}", words(i)) for i in range(60)] + [("c900", "")], "chunk_id string, content string")
    asked = spark.createDataFrame([(q, f"w{q} the the v{q} unknown") for q in range(5)] + [(9, "nothing here")], "query_id int, text string")
    index = bm25.build(chunks)
    assert "RepartitionByExpression" not in plan(index.postings) and "Aggregate" not in plan(index.postings)
    monkeypatch.setattr(bm25, "CHUNKS", 4)
    monkeypatch.setattr(bm25, "QUERIES", 2)
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in bm25.search(index, asked, 7, include_zero=True).collect()}
    idf, avgdl = {r.term: r.idf for r in index.terms.collect()}, index.corpus.first().avgdl
    texts = {f"c{i:03d}": words(i).split() for i in range(60)} | {"c900": []}
    want = {}
    for q, text in [(q, f"w{q} the the v{q} unknown".split()) for q in range(5)] + [(9, ["nothing", "here"])]:
        score = {c: sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in text) for c, w in texts.items()}
        for rank, c in enumerate(sorted(texts, key=lambda c: (-round(score[c], 6), c))[:7], 1):
            want[q, rank] = (c, round(score[c], 6))
    assert got == want


def test_tables_of_many_rows_are_dealt_over_more_tasks_than_cores(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    assert scratch.spread(spark.read.parquet(str(tmp_path / "t")), rows=10).rdd.getNumPartitions() == 100


def test_assembled_documents_send_no_texts_to_the_driver(spark, tmp_path):
    spark.createDataFrame([("a", "a.pdf", "## (54) \n# Short\n## (54) The sheet\n<!-- PB -->\n# Another long heading"), ("b", "b.pdf", "## A heading of more\nx"), ("c", "c_B1.pdf", ""), ("a", "a2.pdf", "x\n<!-- PB -->")], "doc_id string, filename string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    raw = spark.createDataFrame([("a", 1, 2, "| a |\n|---|\n| b |")], "doc_id string, ord int, page int, md string")
    out = metadata.assembled(docs, raw)
    # a file of few bytes may hold texts of many: none of the sides is sent whole, whatever it is estimated at
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.metadata.filename: (r.title, r.metadata.total_pages, len(r.tables)) for r in out.collect()}
    assert got == {"a.pdf": ("The sheet", 3, 1), "a2.pdf": ("The sheet", 3, 1), "b.pdf": ("A heading of more", 1, 0), "c_B1.pdf": (metadata.UNKNOWN, 0, 0)}


def test_titles_are_told_in_a_documents_own_row(spark):
    docs = spark.createDataFrame([("a", "## (54) \n# Short\n \t## (54) The sheet\r\n# Another long heading"), ("b", "x\n#Ten letters\n# Eleven chars"), ("c", "x"), ("d", ""), ("e", None)], "doc_id string, text string")
    out = metadata.titles(docs)
    assert "Generate" not in plan(out) and "Window" not in plan(out)
    assert {r.doc_id: r.title for r in out.collect()} == {"a": "The sheet", "b": "Ten letters", "c": metadata.UNKNOWN}


def test_the_places_of_blocks_and_lines_are_those_of_all_line_breaks(spark):
    rows = [(1, "a\n"), (2, ""), (3, "a\r\n\n"), (4, "\r1. A\x0b2. B"), (5, "1. A\n2. B\n"), (6, "\u2028")]
    texts = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("doc_id", "1 as ord", "'claims' as section", "text")
    split = {r.doc_id: r.l for r in texts.select("doc_id", text.split_lines(texts.text).alias("l")).collect()}
    assert split == {1: ["a"], 2: [], 3: ["a", ""], 4: ["", "1. A", "2. B"], 5: ["1. A", "2. B"], 6: [""]}
    cut = [(r.doc_id, r.blk, r.block) for r in chunking.claims(texts.filter("doc_id in (4, 5)")).orderBy("doc_id", "blk").collect()]
    assert cut == [(4, 0, ""), (4, 1, "1. A"), (4, 2, "2. B"), (5, 1, "1. A"), (5, 2, "2. B")]


def test_a_traversal_for_some_ends_takes_no_other_edge_in_its_last_round(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "b"), ("x", "y"), ("x", "c"), ("b", "z"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    seeds, ends = spark.createDataFrame([("a",), ("b",)], "seed string"), spark.createDataFrame([(n,) for n in "abcd"], "node string")
    plain = {tuple(r) for r in traverse.bfs(edges, seeds, keep=lambda df: df).collect()}
    held = []
    some = {tuple(r) for r in traverse.bfs(edges, seeds, keep=lambda df: held.append(df) or df, ends=ends).collect()}
    assert {r for r in some if r[1] in "abcd"} == {r for r in plain if r[1] in "abcd"} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 1), ("b", "d", 2)}
    assert {r.node for r in held[2].collect()} <= set("abcd") and ("a", "y", 2) in plain


def test_edges_are_kept_and_a_stored_row_is_held_once(spark):
    made = []
    c = ingest.ingested(spark.createDataFrame([("d", "## ABSTRACT\nStainless steel with 2 % of Si for a motor.")], "doc_id string, text string"), keep=lambda df: made.append(df) or df)
    assert c.edges is c.edges and len(made) == 5  # chunks, mentions, entities, relations, edges
    schema = "rel_id string, type string, source_id string, target_id string, properties string, doc_id string, chunk_id string, seq int"
    rows = [(i, kind, "s", "t", f"{i}{seq}", "d", f"c{seq}", seq) for i, kind in (("cites_1", "cites"), ("affects_1", "affects")) for seq in (2, 1, 3)]
    assert {r.rel_id: r.properties for r in graph.stored(spark.createDataFrame(rows, schema)).collect()} == {"cites_1": "cites_11", "affects_1": "affects_13"}


def test_entities_are_not_dealt_by_a_name_that_many_have(spark):
    entities = spark.createDataFrame([(f"e{i}", "Si" if i % 2 else f"Si range {i}") for i in range(20)] + [("x", "Mn")], "entity_id string, name string")
    index, names = name_index.build(entities), spark.createDataFrame([(1, "si"), (2, "RANGE 1")], "query_id int, name string")
    matched, like = graph_search.lexical(names, entities, index), store.find(entities, "si", index=index)
    for out in (matched, like):
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert like.count() == 20 and sorted((r["count"], r.name) for r in matched.groupBy("name").count().collect()) == [(5, "RANGE 1"), (20, "si")]
