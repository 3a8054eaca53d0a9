"""What a task holds is bounded by counted rows, whatever number of partitions a session has set."""

from folioscope.operators import lines, store, tables, traverse
from folioscope.plans import catalogue
from folioscope.sources import scratch

SETTING = "spark.sql.shuffle.partitions"


def test_outlines_deal_and_sort_nothing(spark):
    docs = spark.createDataFrame([("d", "pre\n## ABSTRACT\na\n<!-- PB -->\n12\nb\n## CLAIMS\n1. A\n## ABSTRACT\nc"), ("e", ""), ("f", None)], "doc_id string, text string")
    out = lines.sections(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert [tuple(r) for r in out.orderBy("doc_id", "ord").collect()] == [
        ("d", 1, "preamble", "<!-- PB:1 -->\npre"), ("d", 2, "abstract", "<!-- PB:1 -->\na\n<!-- PB:2 -->\nb\nc"), ("d", 3, "claims", "<!-- PB:2 -->\n1. A"),
    ]


def test_tables_are_stitched_in_one_deal(spark):
    md = "| a | b |\n|---|---|\n| {} | x |"
    rows = [("d", 1, 4, md.format(1)), ("d", 2, 5, md.format(2)), ("d", 3, None, "none"), ("d", 4, 7, "none"), ("d", 5, 8, md.format(5))]
    out = tables.stitched(spark.createDataFrame(rows, "doc_id string, ord int, page int, md string"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("nth").collect()] == [("d", 1, 4, md.format(1) + "\n| 2 | x |"), ("d", 2, 1, "none"), ("d", 3, 7, "none"), ("d", 4, 8, md.format(5))]


def test_settings_are_raised_inside_and_put_back(spark):
    was = spark.conf.get(SETTING)
    with scratch.shuffled(spark, 40):
        assert spark.conf.get(SETTING) == "40"
    with scratch.shuffled(spark, 1):
        assert spark.conf.get(SETTING) == was
    assert spark.conf.get(SETTING) == was


def test_joins_are_dealt_to_as_many_partitions_as_asked(spark):
    rows = spark.createDataFrame([(f"e{i}", [f"c{i}"]) for i in range(20)], "entity_id string, chunk_ids array<string>")
    out = store.chunks_for(rows, rows, parts=33)
    assert out.rdd.getNumPartitions() == 33 and out.count() == 20


def test_a_traversal_raises_partitions_with_its_edges(spark, monkeypatch):
    monkeypatch.setattr(traverse, "ROWS", 2)
    edges, seen = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "src string, dst string"), []

    def keep(df):
        seen.append(int(spark.conf.get(SETTING)))
        return scratch.table(df)

    assert traverse.bfs(edges, edges.select(edges.src.alias("seed")), 2, keep).count() == 119
    assert min(seen) >= 30


def test_mentions_within_documents_make_no_graph(spark, tmp_path):
    spark.createDataFrame([(1, "n", "b", "t", 7, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert catalogue.mentions_within_documents(spark, str(tmp_path)).count() == 0
    assert "entities" not in vars(catalogue.corpus(spark, str(tmp_path)))
