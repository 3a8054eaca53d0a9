"""Every stage of the pipeline against plain Python."""

import re
import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from folioscope.llm import langid, mixing, shared

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    from test_llm_operators import brute_components, shingle_sets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    letterless = spark.createDataFrame([(10_001, "12 34 --", "en", "src1", 8), (10_002, None, "en", "src1", 0)], docs.schema)
    docs, columns = docs.unionByName(letterless), docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = shared.table(stages["language-id"](spark, docs, SF), "test")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {10_001, 10_002}
    two = shared.table(stages["near-duplicates"](spark, one, SF), "test")
    parts = brute_components(shingle_sets({r.doc_id: r.text for r in one.collect()}, 5))
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, c in parts.items() if i == c)
    three = shared.table(stages["decontamination"](spark, two, SF), "test")
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), x))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[a : a + min(13, len(w))]) for a in range(max(1, len(w) - 12))}
    bad = set()
    for r in two.collect():
        w, hit = words(r.text), set()
        for m in {len(x) for x in windows if x}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
        if hit and 20 * len(hit) >= len(w):
            bad.add(r.doc_id)
    assert {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()} == bad
    four = shared.table(stages["mixing"](spark, three, SF), "test")
    assert one.columns == two.columns == three.columns == four.columns == columns
    times = {r.doc_id: r.times for r in mixing.planned(three).select("doc_id", "mix.times").collect()}
    count = {i: 0 for i in times}
    for r in four.collect():
        count[r.doc_id] += 1
    assert count == times
    from tokenizers import Tokenizer
    import public_tokenizers

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    sums = {r.doc_id: zlib.crc32(np.array(encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in three.collect()}
    out = stages["token-output"](spark, four, SF).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == sorted((i, sums[i]) for i, n in times.items() for _ in range(n))
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix string, shard int, row int, near string"
    sea, hill = "the sea was calm and the boats came home before night fell " * 3, "la montagne est haute et la neige tombe sur les sapins verts " * 3
    rows = [(1, sea, "en", "a"), (1, sea, "en", "a"), (2, sea, "en", None), (None, hill, "fr", "b"), (None, hill, "fr", "b"), (3, hill + "encore", "fr", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \n", "fr", "a"), (7, "12 --", None, "a"), (8, sea * 2000, "en", "c")]
    docs = spark.createDataFrame([(*r, None, "m", 1, 2, "n") for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = shared.table(stage(spark, now, SF), "test")
            if name != "token-output":
                assert now.columns == frame.columns
            if name == "near-duplicates" and frame is docs:
                assert sorted(str((r.doc_id, r.text[:3])) for r in now.collect()) in (["(1, 'the')", "(3, 'la ')"], ["(1, 'the')", "(3, 'la ')", "(8, 'the')"])
    assert now.count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert langid.ROWS and set(__spark_entry__.oracle_sql()) <= set(names)
