"""The corpus in versions against one that is ingested at once, and LIKE by q-grams against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph, name_index, store
from folioscope.plans import incremental, ingest
from folioscope.sources import scratch
from folioscope.sources.versioned import Store


def patent(k, more=""):
    return f"## (54) Sheet {k}\n## ABSTRACT\nA silicon steel for a motor core with Si: {k}% and a core loss, see Table {k % 2 + 1}.{more}\n## CLAIMS\n1. A sheet annealed at {700 + k} °C.\n"


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def found_tables(spark, ids):
    return spark.createDataFrame([(i, 0, 3, f"| a |\n|---|\n| Table {n % 2 + 1} |") for n, i in enumerate(ids)], "doc_id string, ord int, page int, md string")


def state(c):
    of = lambda df, *columns: sorted((tuple(str(r[x]) for x in columns) for r in df.collect()))
    rounded = c.index.terms.withColumn("idf", F.round("idf", 9))
    return {
        "chunks": of(c.chunks, "chunk_id", "content", "page", "chunk_type"), "entities": of(c.entities, "entity_id", "type", "name", "properties", "chunk_ids"), "relations": of(c.relations, "rel_id", "type", "source_id", "target_id", "properties", "chunk_id"),
        "postings": of(c.index.postings, "term", "chunk_id", "tf", "dl"), "terms": of(rounded, "term", "df", "idf"), "corpus": [(r.n, r.avgdl and round(r.avgdl, 9)) for r in c.index.corpus.collect()],
    }


def data_files(path):
    root = path.removeprefix("file://") + "/data"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names}


def test_versions_equal_what_is_ingested_at_once(spark):
    path = scratch.folder(spark, "versions")
    texts = {f"EP{k}": patent(k) for k in range(8)}
    tables = found_tables(spark, texts)
    told = incremental.update(Store(spark, path, 5), documents(spark, {i: t + "An old problem with Mn: 3%." if i == "EP3" else t for i, t in texts.items() if i != "EP0"}), tables)
    assert told == {"new": 7, "changed": 0, "removed": 0, "unchanged": 0}
    first = data_files(path)
    now = Store(spark, path)
    told = incremental.update(now, documents(spark, texts), tables)
    assert told == {"new": 1, "changed": 1, "removed": 0, "unchanged": 6} and now.manifest["version"] == 2
    assert {f: t for f, t in data_files(path).items() if f in first} == first  # nothing written before is touched
    touched = {r[0] for r in documents(spark, {"EP0": "", "EP3": ""}).select(now.bucket()).collect()}
    assert set(now.manifest["live"]["2"]) == touched and now.manifest["dirty"] == [r[0] for r in documents(spark, {"EP3": ""}).select(now.bucket()).collect()]
    expected = state(ingest.ingested(documents(spark, texts), tables))
    assert state(incremental.corpus(Store(spark, path))) == expected
    # the links of the old form stay until its bucket is written anew
    live = {(r.chunk_id, r.entity_id) for r in graph.chunk_entities(incremental.corpus(now).entities).collect()}
    stale = {(r.chunk_id, r.entity_id) for r in incremental.links(now).collect()} - live
    assert stale and all(e.startswith("EP3_") for _, e in stale)
    before = data_files(path)
    assert set(incremental.compacted(now)) == touched and now.manifest["dirty"] == []
    assert {f: t for f, t in data_files(path).items() if f in before} == before
    assert set(now.manifest["live"]["1"]).isdisjoint(touched) and set(now.manifest["live"]["3"]) == touched
    assert state(incremental.corpus(Store(spark, path))) == expected
    assert {(r.chunk_id, r.entity_id) for r in incremental.links(now).collect()} == live
    assert incremental.update(now, documents(spark, texts), tables)["unchanged"] == 8 and now.manifest["version"] == 3
    # documents that go, one of them the first with a label
    told = incremental.update(now, documents(spark, {}), None, removed=spark.createDataFrame([("EP0",), ("EP5",), ("none",)], "doc_id string"))
    assert told["removed"] == 2
    left = {i: t for i, t in texts.items() if i not in ("EP0", "EP5")}
    assert state(incremental.corpus(Store(spark, path))) == state(ingest.ingested(documents(spark, left), tables.filter("doc_id not in ('EP0', 'EP5')")))
    # and one that comes back as it was
    assert incremental.update(now, documents(spark, {"EP0": texts["EP0"]}), tables.filter("doc_id = 'EP0'"))["new"] == 1


def test_an_empty_store_and_writers_that_meet(spark):
    path = scratch.folder(spark, "versions")
    one, two = Store(spark, path, 3), Store(spark, path, 3)
    assert incremental.update(one, documents(spark, {})) == {"new": 0, "changed": 0, "removed": 0, "unchanged": 0}
    assert incremental.compacted(one) == []
    assert incremental.update(one, documents(spark, {"A": patent(1)}))["new"] == 1
    with pytest.raises(FileExistsError):
        two.commit({**two.manifest, "version": 1})
    with pytest.raises(ValueError, match="no table"):
        one.read("unknown")


def test_stored_files_are_not_converted_again(spark, tmp_path):
    folder, output, calls = tmp_path / "in", scratch.folder(spark, "versions"), tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()

    def convert(content):
        import uuid

        (calls / uuid.uuid4().hex).write_bytes(content)
        if content.startswith(b"bad"):
            raise ValueError("no document")
        return content.decode(), []

    def run():
        told = incremental.update_folder(spark, str(folder), output, convert, "*.md")
        made = sorted(p.read_bytes()[:9] for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return told, len(made)

    for k in (1, 2):
        (folder / f"EP{k}.md").write_text(patent(k))
    (folder / "EP9.md").write_text("bad")
    assert run() == ({"new": 2, "changed": 0, "removed": 0, "unchanged": 0, "failed": 1}, 3)
    assert run() == ({"new": 0, "changed": 0, "removed": 0, "unchanged": 0, "failed": 1}, 1)
    (folder / "EP2.md").write_text(patent(2, " More."))
    (folder / "EP9.md").write_text(patent(9))
    assert run() == ({"new": 1, "changed": 1, "removed": 0, "unchanged": 0, "failed": 0}, 2)
    assert {r.doc_id for r in Store(spark, output).current().collect()} == {"EP1", "EP2", "EP9"}


def like(name, pattern):
    own = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.search(own, name.lower(), re.DOTALL) is not None


def test_patterns_find_the_names_that_a_scan_finds(spark):
    rng = random.Random(2)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    names = {text("aAbB_%é\\ \n", 9) for _ in range(600)} | {"", "core_loss", "Core Loss", "x" * 500}
    patterns = {text("aAbB_%é\\", 6) for _ in range(300)} | {"", "%", "_", "___", "core_loss", "unknown", "X" * 400, "\\"}
    rows = spark.createDataFrame([(n, f"e{k}") for k, n in enumerate(sorted(names))] + [(None, "none")], "name string, entity_id string")
    index = name_index.build(rows, scratch.table)
    asked = spark.createDataFrame([(p,) for p in sorted(patterns)] + [(None,)], "pattern string")
    found = name_index.lookup(index, asked)
    assert {(r.pattern, r.name) for r in found.collect()} == {(p, n) for p in patterns for n in names if like(n, p)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for pattern in ("core_loss", "b_", "\\", "%"):
        expected = {n for n in names if like(n, pattern)}
        assert {r.name for r in store.find(rows, pattern, index=index).collect()} == expected == {r.name for r in store.find(rows, pattern).collect()}


def test_only_the_rarest_pieces_are_read(spark):
    rows = spark.createDataFrame([(f"common start {k}",) for k in range(200)] + [("common start zebra",)], "name string")
    index = name_index.build(rows, scratch.table)
    counts = {r.gram: r.n for r in index.counts.collect()}
    assert counts["com"] == 201 and counts["zeb"] == 1 and counts[""] == 201
    found = name_index.lookup(index, spark.createDataFrame([("common%zebra",)], "pattern string"))
    assert [tuple(r) for r in found.collect()] == [("common%zebra", "common start zebra")]
