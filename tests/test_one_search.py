"""A corpus that is asked once: what is made for the questions alone, and what is read once."""

import pyarrow as pa

from folioscope.operators import automaton, bm25, entities, graph, graph_search, impacts, name_index, traverse
from folioscope.sources.vocabulary import DEFAULT

TEXTS = [
    ("EP1_0000", "EP1", 0, "Carbon steel has Si: 2.5% and a yield stress. See Table 1. Inventor: Ada Rossi; Si Lee", "paragraph"),
    ("EP1_0001", "EP1", 1, "Table 1 | yield stress | 7", "table"),
    ("EP2_0000", "EP2", 0, "It is annealed at 800 °C. Table 1 and Formula (2) give Si: 3% of stainless steel for a motor core.", "paragraph"),
    ("EP2_0001", "EP2", 1, "Applicant: Basic 50_x Works\nThe Si_sheet, a problem is the price.", "paragraph"),
    ("EP3_0000", "EP3", 0, "", "paragraph"),
]
SCHEMA = "chunk_id string, doc_id string, seq int, content string, chunk_type string"
rows = lambda df: sorted(map(tuple, df.collect()))


def test_an_index_for_some_questions_ranks_as_the_whole_one(spark):
    chunks = spark.createDataFrame(TEXTS, SCHEMA)
    asked = spark.createDataFrame([(1, "Si and si: a table"), (2, "unheard"), (3, "")], "query_id long, text string")
    own = bm25.build_for(chunks, asked, lambda df: df)
    assert {r.term for r in own.postings.collect()} == {"si", "and", "a", "table"}
    whole = bm25.build(chunks)
    for zero in (False, True):
        assert rows(bm25.search(own, asked, 3, zero)) == rows(bm25.search(whole, asked, 3, zero))
    long = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(bm25.ASKED + 1)))], "query_id long, text string")
    assert bm25.build_for(chunks, long, lambda df: df) is None


def test_few_names_are_met_without_an_index(spark, monkeypatch):
    named = spark.createDataFrame([("a", "50_x"), ("b", "5\\0x"), ("c", "SILICON"), ("d", None), ("e", "silicon")], "entity_id string, name string")
    asked = spark.createDataFrame([(q, n) for q, n in enumerate(("si", "0_x", "5\\0", "Si", "%", None, "none"))], "query_id long, name string")
    by_index = rows(graph_search.lexical(asked, named, name_index.build(named)))

    def never():
        raise AssertionError("made an index of all names for a few")

    assert rows(graph_search.lexical(asked, named, never)) == by_index
    assert len(by_index) == 2 + 1 + 1 + 2 + 4
    monkeypatch.setattr(graph_search, "FEW", 2)
    assert rows(graph_search.lexical(asked, named, lambda: name_index.build(named))) == by_index


def test_ways_are_the_edges_of_stored_relations(spark):
    chunks = spark.createDataFrame(TEXTS, SCHEMA)
    merged = graph.merged(entities.extracted(chunks))
    whole = graph.edges(graph.stored(graph.relations(chunks, merged)))
    assert rows(graph.edges_within(chunks, merged).distinct()) == rows(whole) != []


def test_graph_scores_are_those_of_each_seed(spark):
    """A question's name that is told twice counts twice for its own chunks; what a seed reaches counts once."""
    chunks = spark.createDataFrame([(c, "d", 0) for c in "uvw"], "chunk_id string, doc_id string, seq int")
    at = spark.createDataFrame([("x1", "u"), ("x2", "u"), ("y", "v"), ("z", "w"), ("x1", "w")], "entity_id string, chunk_id string")
    named = spark.createDataFrame([("x1", "ex"), ("x2", "exit"), ("y", "why"), ("z", "zed")], "entity_id string, name string")
    edges = spark.createDataFrame([("x1", "y"), ("x1", "x1"), ("x2", "y"), ("y", "z"), ("y", "x1"), ("x1", "y")], "src string, dst string")
    asked = spark.createDataFrame([(1, "ex"), (1, "ex"), (1, "exit"), (2, "zed"), (2, "ex")], "query_id long, name string")
    found = {(r.query_id, r.chunk_id): r.score for r in graph_search.search(asked, named, edges, at, chunks).collect()}
    # question 1: x1 twice, x2 three times; x1 reaches y, z; x2 reaches y, z, x1
    assert found == {(1, "u"): 2 + 3 + 0.25, (1, "v"): 0.5 + 0.5, (1, "w"): 2 + 0.25 + 0.25 + 0.25, (2, "u"): 1 + 1 + 0.25, (2, "v"): 0.5 + 0.5, (2, "w"): 1 + 1 + 0.25 + 0.25 + 0.25}


def test_a_seed_may_be_named_apart_from_its_node(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "a")], "src string, dst string")
    seeds = spark.createDataFrame([(7, "a")], "seed long, node string")
    assert rows(traverse.bfs(edges, seeds, 2, keep=lambda df: df)) == [(7, "b", 1), (7, "c", 2)]


def test_equal_texts_of_a_batch_are_read_once():
    read, find = [], automaton.Vocabulary(DEFAULT)
    texts = ["Si: 2.5%", None, "annealed at 800 °C", "Si: 2.5%", None, "Si: 2.5%"]
    told = automaton.read(pa.array(texts), lambda x: read.append(x) or find(x))
    assert sorted(x for x in read if x) == ["Si: 2.5%", "annealed at 800 °C"]
    assert told.to_pylist() == pa.array([find(x) for x in texts], automaton._TYPE).to_pylist()


def test_some_extractors_give_what_they_give_among_all(spark, monkeypatch):
    chunks = spark.createDataFrame(TEXTS, SCHEMA)
    whole = rows(entities.extracted(chunks))
    for only in (("processes",), ("elements", "materials"), ("references", "samples", "cited", "inventors", "assignees", "patdocs")):
        numbers = {entities.EXTRACTORS.index(x) for x in only}
        assert rows(entities.extracted(chunks, only=only)) == [r for r in whole if r[3] in numbers] != []
    entities._expressions.cache_clear()

    def never(*_):
        raise AssertionError("asked the vocabulary for what patterns tell")

    monkeypatch.setattr(entities, "hits", never)
    assert entities.extracted(chunks, only=("references", "patdocs")).count() == 4
    entities._expressions.cache_clear()


def test_postings_in_blocks_are_dealt_once(spark):
    kept = []
    index = bm25.build(spark.createDataFrame(TEXTS, SCHEMA))
    impacts.build(index, lambda df: kept.append(df) or df)
    assert "rangepartitioning" not in kept[0]._jdf.queryExecution().toString()
