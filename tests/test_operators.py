"""Operators on small rows with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import bm25, chunking, context, entities, evaluate, fusion, graph, graph_search, lines, metadata, store, tables, traverse, vectors
from folioscope.operators.interfaces import Echo, HashedWords, encoded, reranker
from folioscope.plans import catalogue, ingest
from folioscope.sources import config, readers, scratch, vocabulary, writers
from folioscope.streaming import ingest as streaming


def docs(spark, text, doc_id="EP1"):
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")


def chunk(spark, *texts, kind="paragraph", doc_id="EP1"):
    rows = [(f"{doc_id}_{i:04d}", doc_id, i, t, "claims", 1, kind) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, seq int, content string, section string, page int, chunk_type string")


def test_sections_pages_and_noise(spark):
    text = "## ABSTRACT\ntext\n12\n<!-- PB -->\nmore\n## CLAIMS\n1. A sheet."
    found = {r.section: r.text for r in lines.sections(docs(spark, text)).collect()}
    assert found == {"abstract": "<!-- PB:1 -->\ntext\n<!-- PB:2 -->\nmore", "claims": "<!-- PB:2 -->\n1. A sheet."}


def test_tables_of_equal_width_are_stitched(spark):
    md = lambda n, x: "| " + " | ".join(x for _ in range(n)) + " |"
    rows = [("d", i, p, f"{md(n, 'h')}\n{md(n, '---')}\n{md(n, str(p))}") for i, (n, p) in enumerate([(2, 4), (2, 5), (3, 6)])]
    found = tables.stitched(spark.createDataFrame(rows, "doc_id string, ord int, page int, md string")).orderBy("nth").collect()
    assert [r.page for r in found] == [4, 6] and found[0].md.endswith("| 4 | 4 |\n| 5 | 5 |")


def test_claims_carry_pages(spark):
    text = "<!-- PB:3 -->\n1. A\nb\n2. C\n<!-- PB:4 -->\n3. D"
    rows = spark.createDataFrame([("d", 1, "claims", text)], "doc_id string, ord int, section string, text string")
    assert [(r.content, r.page, r.chunk_type) for r in chunking.chunks(rows).orderBy("seq").collect()] == [("1. A\nb", 3, "claim"), ("2. C", 4, "claim"), ("3. D", 4, "claim")]


def test_tag_branch_needs_a_tag_at_the_start(spark):
    schema = "doc_id string, ord int, section string, text string"
    count = lambda t: chunking.chunks(spark.createDataFrame([("d", 1, "abstract", t)], schema)).count()
    assert count("<!-- PB:1 -->\n[0001] a\n[0002] b") == 1 and count("[0001] a\n[0002] b") == 2


def test_references(spark):
    rows = chunk(spark, "See Table 1, FIG. 2, Figure 2 and Equation (3)")
    found = rows.select(F.inline(chunking.references(F.col("content"), F.col("doc_id")))).collect()
    assert [(r.raw_text, r.ref_id) for r in found] == [("Table 1", "EP1_TABLE_01"), ("FIG. 2", "EP1_FIGURE_02"), ("Equation (3)", "EP1_FORMULA_03")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Si: 2.5%", [("chemical_element", "Si", '"value":2.5')]),
        ("2.5% to 10% by mass of Si", [("composition_range", "Si_range", '"element":"Si","min_val":2.5,"max_val":10.0,"unit":"%"'), ("chemical_element", "Si", '"value":10.0')]),
        ("core loss: 3 W/kg", [("property", "core_loss", '"value":3.0')]),
        ("core loss: 2.5 W/kg", [("property", "core_loss", '{"alias":"core loss"}')]),
        ("coating on 10 coils", [("process", "coating", '"temperature":10,"temperature_unit":"°C"')]),
        ("Sample A1 of Patent Document 2", [("sample", "Sample A1", '"sample_id":"A1"'), ("patent_doc_reference", "Patent Document 2", '"doc_number":2')]),
        ("a battery", [("application", "energy_storage", '"matched_alias":"battery"')]),
        ("ſi: 2%", [("chemical_element", "Si", '"value":2.0')]),
        ("a known drawback. Next", [("problem", "a known drawback.", "drawback")]),
    ],
)
def test_mentions(spark, text, expected):
    found = entities.extracted(chunk(spark, text)).orderBy("extractor", "k").collect()
    assert [(r.type, r.name) for r in found] == [e[:2] for e in expected] and all(e[2] in r.properties for r, e in zip(found, expected))


def test_colliding_ids_merge_to_the_first(spark):
    merged = graph.merged(entities.extracted(chunk(spark, "Si: 1%", "Si: 2%"))).collect()
    assert len(merged) == 1 and '"value":1.0' in merged[0].properties and merged[0].chunk_ids == ["EP1_0000", "EP1_0001"]


def test_first_and_last_wins(spark):
    rows = chunk(spark, "Si: 1% and the core loss of carbon steel in a battery", "Si: 2% and the core loss of carbon steel in a battery")
    found = {r.type: r.chunk_id for r in graph.stored(graph.relations(rows, graph.merged(entities.extracted(rows)))).collect()}
    assert found["affects"] == "EP1_0001" and found["used_for"] == "EP1_0000"


def test_table_labels_by_scope(spark):
    a, b = chunk(spark, "Table 1", kind="table", doc_id="A"), chunk(spark, "Table 1", kind="table", doc_id="B")
    rows = a.unionByName(b).unionByName(chunk(spark, "x", "see Table 1", doc_id="B").filter("seq = 1"))
    merged = graph.merged(entities.extracted(rows))
    to = lambda scope: [r.target_id for r in graph.relations(rows, merged, scope).filter("type = 'mentions'").collect()]
    assert to("global") == ["A_0000"] and to("document") == ["B_0000"]


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    found = traverse.bfs(edges, spark.createDataFrame([("a",), ("z",)], "seed string"), 2).collect()
    assert {(r.seed, r.node): r.dist for r in found} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}


def test_every_customer_is_a_seed(spark):
    sf = "/root/testdata/sf0.001"
    seeds = {r.seed for r in catalogue.QUERIES["bfs_orders"](spark, sf).select("seed").distinct().collect()}
    assert seeds == {f"c{r.c_custkey}" for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}


def test_fusion(spark):
    hit = lambda rank: spark.createDataFrame([(1, "x", rank, 0.5)], "query_id long, chunk_id string, rank int, score double")
    row = fusion.fused(fusion.merged({"bm25": hit(1), "semantic": hit(3), "graph": hit(5)})).first()
    assert row.rrf_score == pytest.approx(1 / 61 + 1 / 63 + 1.2 / 65, abs=1e-8) and row.score_breakdown == "BM25: 0.0164 + Sem: 0.0159 + Graph: 0.0154"


def test_frequent_terms_get_a_share_of_the_mean_idf(spark):
    index = bm25.build(spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d")], "chunk_id long, content string"))
    idf = {r.term: r.idf for r in index.terms.collect()}
    import math

    raw = {"a": math.log(0.5) - math.log(3.5)} | dict.fromkeys("bcd", math.log(2.5) - math.log(1.5))
    assert idf["a"] == pytest.approx(0.25 * sum(raw.values()) / 4) and idf["b"] == pytest.approx(raw["b"])
    found = bm25.search(index, spark.createDataFrame([(1, "b b")], "query_id long, text string"), 2, include_zero=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.score > 0) for r in found] == [(1, True), (2, False)]


def test_vectors_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.0, 5.0])], "query_id long, embedding array<double>")
    assert [(r.chunk_id, r.score) for r in vectors.search(rows, asked, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert vectors.search(rows, asked.limit(0)).count() == 0


def test_signals_and_citations(spark):
    rows = spark.createDataFrame([(5, 0.01), (6, 0.01), (None, 0.03)], "g int, r double")
    assert [r[0] != "" for r in rows.select(context.signal(F.col("g"), F.col("r"))).collect()] == [True, False, True]
    row = spark.createDataFrame([("a [Source 1, Source 2] b Source 3 (Page: 7)", ["x", "y"])], "a string, l array<string>").select(context.cited_numbers(F.col("a")).alias("n"), context.with_badges(F.col("a"), F.col("l")).alias("b")).first()
    assert row.n == [1, 2, 3] and row.b == "a [1][x] [2][y] b Source 3 (Page: 7)"


def test_citations_of_every_part(spark):
    sf = "/root/testdata/sf0.001"
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    found = catalogue.QUERIES["citations"](spark, sf).collect()
    assert sorted(r.p_partkey for r in found) == sorted(parts)
    for r in found:
        p = parts[r.p_partkey]
        n, known = 1 + p.p_size % 5, [p.p_brand, p.p_type, "z"]
        assert r.badges.startswith(f"See [{n}][{known[n - 1]}] [2]" if n <= 3 else f"See [Source {n}] [2]") and r.numbers.startswith(f"{n},2,")


def test_failed_cases_count_as_zero(spark):
    cases = spark.createDataFrame([(1, "c"), (2, "c")], "query_id long, category string")
    hits = spark.createDataFrame([(1, 1, "t", 1, None, 1)], "query_id long, final_rank int, content string, bm25_rank int, semantic_rank int, graph_rank int")
    found = evaluate.details(cases, hits, fusion.stats(hits))
    row = evaluate.by_category(found).first()
    assert (row["count"], row.avg_contexts, row.avg_bm25_hits, row.avg_semantic_hits) == (2, 0.5, 0.5, 0.0)
    assert "| c | 2 |" in evaluate.report(evaluate.by_category(found), evaluate.contribution(fusion.stats(hits)))


def test_datasets(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps([{"user_input": "q", "reference": "r"}, {"user_input": "p", "reference": "s"}]))
    assert [(r.id, r.retrieval_type) for r in readers.dataset(spark, str(tmp_path / "a.json")).orderBy("id").collect()] == [("G1", "hybrid"), ("G2", "hybrid")]
    (tmp_path / "b.json").write_text(json.dumps({"test_cases": [{"id": 1, "question": "q"}]}))
    assert readers.dataset(spark, str(tmp_path / "b.json")).first().category == "generated"
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.dataset(spark, str(tmp_path / "c.json"))


def test_files_converters_and_sinks(spark, tmp_path):
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_bytes(b"x" if name == "a.pdf" else b"!")

    def convert(content):
        if content == b"!":
            raise ValueError("broken")
        return "# T", [("| a |", None)]

    found = {r.path[-5:]: (r.text, r.error, len(r.tables)) for r in readers.converted(spark, str(tmp_path), convert).collect()}
    assert found == {"a.pdf": ("# T", None, 1), "b.pdf": (None, "ValueError: broken", 0)}
    index = bm25.build(spark.createDataFrame([(1, "a b")], "chunk_id long, content string"))
    writers.index(index, str(tmp_path / "index"))
    assert writers.read_index(spark, str(tmp_path / "index")).postings.count() == 2


def test_stand_ins_and_settings(spark):
    rows = spark.createDataFrame([("a b a", 1)], "prompt string, chunk_count int")
    assert sum(rows.select(encoded(F.col("prompt"), HashedWords(8)).alias("e")).first().e) == 3
    assert context.answers(rows, Echo()).first().metadata.model == "echo"
    assert config.Settings.from_env({"RERANKER_ENABLED": "Yes"}).reranker and config.Settings().with_weights(graph=0.0).weights["graph"] == 0.0
    assert vocabulary.as_table(spark).filter("kind = 'processes'").count() == 17


def test_upsert_and_lookups(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, n int")
    assert sorted(map(tuple, store.upsert(old, new, "id", "n").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_every_order_is_a_change(spark):
    sf, last = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        last[r.o_custkey] = max(r.o_orderkey, last.get(r.o_custkey, 0))
    names = {r.c_custkey: f"order {last[r.c_custkey]}" if r.c_custkey in last else r.c_name for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r.id: r.name for r in catalogue.QUERIES["upserted"](spark, sf).collect()} == names


def test_document_ids(spark):
    rows = spark.createDataFrame([("x/ep12_A1.pdf", ""), ("x/n.pdf", "see US 99"), ("x/n.v2.pdf", "")], "f string, t string")
    found = rows.select(metadata.document_id(F.col("f"), F.col("t")).alias("i"), metadata.kind_code(F.col("f")).alias("k")).collect()
    assert [(r.i, r.k) for r in found] == [("EP12", "A1"), ("US99", None), ("n.v2", None)]


def test_model_answers(spark):
    rows = spark.createDataFrame([("c", "d", 0, '{"compositions":[{"element":"Si","min_val":1.0,"unit":"%"}],"processes":[{"name":"annealing","temperature":800,"parameters":{"gas":"N2"}}],"patent_meta":{"problems":["cost"]}}'), ("c2", "d", 1, "not json"), ("c3", "d", 2, None)], "chunk_id string, doc_id string, seq int, answer string")
    found = entities.from_model(rows).orderBy("k").collect()
    assert [(r.entity_id, r.type, r.name) for r in found] == [("d_Si_llm_0", "chemical_element", "Si"), ("d_annealing_llm_1", "process", "annealing"), ("d_problem_2", "problem", "cost")]
    assert found[0].properties == '{"min_val":1.0,"unit":"%","source":"llm"}' and all(x in found[1].properties for x in ('"temperature":"800.0"', '"gas":"N2"', '"source":"llm"'))


@pytest.fixture(scope="module")
def graph_tables(spark):
    rows = spark.createDataFrame([("e1", "chemical_element", "Si", "{}", "D", ["c1"]), ("e2", "property", "core_loss", "{}", "D", ["c2"]), ("e3", "material", "silicon_steel", "{}", "D", ["c1", "c3"])], readers.ENTITIES)
    edges = spark.createDataFrame([("e1", "e2"), ("e3", "e2")], "src string, dst string")
    return rows, edges, graph.chunk_entities(rows), spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string")


def test_a_seed_that_is_named_twice_is_traversed_once(spark, graph_tables):
    names = spark.createDataFrame([(1, "Si"), (1, "Si"), (1, "silicon"), (2, "nothing")], "query_id long, name string")
    found = {(r.query_id, r.chunk_id): r.score for r in graph_search.search(names, *graph_tables).collect()}
    # e1 is named twice; e3 twice by its symbol's letters and once by itself; each reaches e2 once
    assert found == {(1, "c1"): 5.0, (1, "c3"): 3.0, (1, "c2"): 1.0}


def test_names_are_found_by_their_vectors(spark, graph_tables):
    rows = graph_tables[0]
    vecs = rows.select("entity_id", encoded(F.col("name"), HashedWords(32)).alias("embedding"))
    names = spark.createDataFrame([(1, "core_loss")], "query_id long, name string")
    matches = graph_search.semantic(names, vecs, HashedWords(32))
    assert [tuple(r) for r in matches.collect()] == [("core_loss", "e2")]
    assert [(r.chunk_id, r.score) for r in graph_search.search(names, *graph_tables, matches=matches).collect()] == [("c2", 1.0)]


def test_many_questions_meet_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(9, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)] + [(90, None), (91, [1.0]), (92, [None] * 5)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "query_id long, embedding array<double>")
    one = sorted(map(tuple, vectors.search(rows, asked, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    assert sorted(map(tuple, vectors.search(rows, asked, 3).collect())) == one and len(one) == 27
    score = (b / np.linalg.norm(b, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
    assert {(q, c) for q, c, *_ in one} == {(q, c) for q in range(9) for c in np.argsort(-score[q])[:3].tolist()}
    assert vectors.search(rows, asked, 3, threshold=2.0).count() == 0


def test_ingestion_from_a_folder(spark, tmp_path, capsys):
    folder, out = tmp_path / "raw", str(tmp_path / "out")
    folder.mkdir()
    (folder / "EP1_B1.md").write_text("## (54) Steel\n\n## ABSTRACT\nSi: 2.5% lowers the core loss.\n<!-- PB -->\nTable 1 follows.\n")
    (folder / "EP2.md").write_text("## CLAIMS\n1. carbon steel for a battery")
    (folder / "EP3.md").write_text("unasked")
    told = ingest.main([*("ep1_b1.md", "EP2.md", "EP9.md"), "--folder", str(folder), "--output", out], spark=spark)
    assert told["found"] == 3 and told["missing"] == ["EP9.md"] and told["documents"] == 2 and told["errors"] == 0 and "not found: EP9.md" in capsys.readouterr().out
    c = ingest.loaded(spark, out)
    assert {r.doc_id for r in c.chunks.collect()} == {"EP1", "EP2"} and c.entities.filter("name = 'Si'").count() == 1
    asked = spark.createDataFrame([(1, "Which steel is for a battery?")], "query_id long, text string")
    vecs = c.chunks.select("chunk_id", encoded(F.col("content"), HashedWords()).alias("embedding"))
    top = ingest.retrieved(c, asked, vecs, asked.select("query_id", encoded(F.col("text"), HashedWords()).alias("embedding")))
    assert top.orderBy("rrf_rank").first().chunk_id == "EP2_0000" and top.filter("bm25_rank is null").count() == 0
    whole = {r.doc_id: r for r in spark.read.parquet(f"{out}/corpus/documents").collect()}
    assert whole["EP1"].title == "Steel" and whole["EP1"].metadata.total_pages == 2 and whole["EP1"].num_chunks == 2 and [x.section for x in whole["EP1"].sections] == ["preamble", "abstract"]


def test_semantic_entities_are_a_setting(spark):
    docs = spark.createDataFrame([("EP1", "## CLAIMS\n1. carbon steel for a battery")], "doc_id string, text string")
    c = ingest.ingested(docs, encoder=HashedWords(64))
    assert c.entity_vectors.count() == c.entities.count()
    asked = spark.createDataFrame([(1, "Is there carbon steel?")], "query_id long, text string")
    vecs = c.chunks.select("chunk_id", encoded(F.col("content"), HashedWords(64)).alias("embedding"))
    for on in (False, True):
        settings = config.Settings.from_env({"GRAPH_SEMANTIC_ENTITY_SEARCH": "true" if on else "no"})
        found = ingest.hits(c, asked, vecs, vecs.select(F.lit(1).cast("long").alias("query_id"), "embedding"), settings=settings, encoder=HashedWords(64))
        assert found["graph"].count() == 1


def test_settings_judges_and_command_lines():
    of = config.Settings.from_env({"RERANKER_ENABLED": "1", "OLLAMA_API_BASE": "http://x", "LOG_LEVEL": "debug"})
    assert (of.api_base, of.log_level, of.reranker_model) == ("http://x", "DEBUG", config.Settings.reranker_model)
    assert reranker(config.Settings()) is None and reranker(of) is not None and reranker(of, lambda name: name) == of.reranker_model
    assert [config.judge(a, b) for a, b in (("gpt-4", "m"), ("gpt-4o", "m"), (None, "m"), (None, None))] == [("chat", "gpt-4"), ("any", "gpt-4o"), ("any", "m"), ("chat", "gpt-3.5-turbo")]
    assert config.evaluation_arguments(["--dataset", "x", "--top-k", "3"]).top_k == 3 and config.dataset_arguments([]).size == 20 and config.report_arguments(["r", "--max-questions", "2"]).max_questions == 2
    assert "".join(Echo().stream("ab")).strip() == Echo()(["ab"])[0] == Echo().chat([{"role": "system", "content": "x"}, {"role": "user", "content": "ab"}])
    assert "".join(context.stream_answer(Echo(), "q", "c")).startswith("See [Source 1].")


def test_reports_and_results(spark, tmp_path):
    cases = spark.createDataFrame([(1, "G1", "a", "why"), (2, "G2", "a", "how")], "query_id long, id string, category string, question string")
    hits = spark.createDataFrame([(1, 1, "text", 1, None, 1)], "query_id long, final_rank int, content string, bm25_rank int, semantic_rank int, graph_rank int")
    details = evaluate.details(cases, hits, fusion.stats(hits), spark.createDataFrame([(1, "so")], "query_id long, answer string"))
    categories, shares = evaluate.by_category(details), evaluate.contribution(fusion.stats(hits))
    metrics = evaluate.metric_means(spark.createDataFrame([("recall", "0.5"), ("recall", "n/a")], "metric string, value string"))
    writers.results(details, categories, metrics, str(tmp_path / "r"))
    assert sorted((r.id, r.error, len(r.contexts)) for r in readers.results(spark, str(tmp_path / "r")).collect()) == [("G1", None, 1), ("G2", "no hits", 0)]
    assert "recall: 0.5000" in evaluate.summary(details, categories, shares, metrics) and "Questions: 2" in evaluate.summary(details, categories, shares, metrics)
    told = evaluate.detailed(details)
    assert "[1] G1 - a" in told and "Answer: so" in told and "Error: no hits" in told and "[2]" not in evaluate.detailed(details, 1)
    writers.json_lines(categories, str(tmp_path / "j"))
    writers.csv(categories, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_custom_sets_as_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"test_cases": [{"id": "1", "question": "q", "category": "c"}, {"id": "2", "question": "p"}]}')
    assert [(r.id, r.category, r.retrieval_type) for r in readers.test_set(spark, str(tmp_path / "a.json")).orderBy("id").collect()] == [("1", "c", "hybrid"), ("2", "generated", "hybrid")]


def test_mentions_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "d", "text": "Si: 2%\\n\\ncarbon steel"}')
    rows = spark.readStream.schema("doc_id string, text string").json(str(tmp_path / "in"))
    run = streaming.mentions(rows).writeStream.format("memory").queryName("mentions_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.chunk_id, r.name) for r in spark.sql("select * from mentions_seen").collect()) == [("d_0000", "Si"), ("d_0001", "carbon_steel")]


def test_scratch_tables_are_deleted_and_shared(spark):
    import os

    out = scratch.table(spark.range(3).toDF("n"), "t")
    path = scratch._AT[out].removeprefix("file://")
    assert os.path.isdir(path)
    scratch.drop(out)
    assert not os.path.isdir(path) and scratch.fresh(spark.range(1).toDF("Row"), "row") == "row_"

    class Session:
        def __init__(self, master, named=None):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": named} if named else {}, type("c", (), {"master": master})

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch.root(Session(master))
        assert scratch.root(Session(master, "hdfs://a/b/")) == "hdfs://a/b"
    assert scratch.root(Session("local[8]")).startswith("file://")


def test_queries_leave_no_views_behind(spark):
    sf = "/root/testdata/sf0.001"
    spark.range(1).createOrReplaceTempView("part")
    catalogue.QUERIES["titles"](spark, sf).collect()
    assert spark.table("part").columns == ["id"]
    spark.catalog.dropTempView("part")
