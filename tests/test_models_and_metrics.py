"""Models that live in their workers and fail at times, and metrics by rank and by a judge."""

import json
import math
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.operators import context, evaluate, models
from folioscope.operators.interfaces import Echo, HashedWords, encoded
from folioscope.plans import ingest
from folioscope.sources import config

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class Counting:
    """Answers in capitals; notes how it was made and called; fails where it is told to."""

    def __init__(self, folder, fails=(), flaky=False):
        self.folder, self.fails, self.flaky, self.seen = folder, fails, flaky, set()
        (folder / f"made-{uuid.uuid4().hex}").write_text("")

    def __call__(self, items):
        if self.flaky and items[0] not in self.seen:
            self.seen.add(items[0])
            raise TimeoutError("once")
        if any(f in x for x in items for f in self.fails):
            raise RuntimeError("no answer")
        for x in items:
            (self.folder / f"asked-{uuid.uuid4().hex}").write_text(x)
        return [x.upper() for x in items]


def noted(folder, kind):
    return sorted(p.read_text() for p in folder.iterdir() if p.name.startswith(kind))


def test_a_model_is_made_once_a_worker_and_asked_once_an_input(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k % 40}" if k % 50 else None) for k in range(1, 400)], "id int, x string").repartition(6)
    model = models.Resident(lambda: Counting(tmp_path, fails=("q7",)), "counting")
    out = models.called(rows, ["x"], model, batch=8)
    got = {r.id: (r.x, r.result, r.error) for r in out.collect()}
    assert len(got) == 399 and out.count() == 399  # reading again asks nothing
    for x, result, error in got.values():
        assert (result, error) == ((None, None) if x is None else (None, "RuntimeError: no answer") if x == "q7" else (x.upper(), None))
    assert noted(tmp_path, "asked") == sorted(f"q{k}" for k in range(40) if k != 7)
    assert len(noted(tmp_path, "made")) <= 16  # workers, not batches or rows
    # kept answers aren't asked for again, failed ones are
    before = noted(tmp_path, "asked")
    again = models.called(rows, ["x"], models.Resident(lambda: Counting(tmp_path)), known=models.kept(out))
    assert {r.id: r.result for r in again.collect()} == {k: x and x.upper() for k, (x, _, _) in got.items()}
    assert sorted(noted(tmp_path, "asked")) == sorted([*before, "q7"])


def test_failing_batches_and_wrong_numbers_of_results(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{k}",) for k in range(20)], "x string").coalesce(1)
    flaky = models.called(rows, ["x"], models.Resident(lambda: Counting(tmp_path, flaky=True)), batch=5)
    assert {r.x: r.result for r in flaky.collect()} == {f"q{k}": f"Q{k}" for k in range(20)}
    short = models.called(rows, ["x"], lambda items: items[1:])
    assert {(r.result, r.error) for r in short.collect()} == {(None, "ValueError: 0 results for 1 inputs")}
    pairs = models.called(rows.withColumn("y", F.lit("z")), ["x", "y"], lambda items: [float(len(a + b)) for a, b in items], "double")
    assert {r.x: r.result for r in pairs.collect()} == {f"q{k}": len(f"q{k}z") for k in range(20)}
    assert models.called(rows.limit(0), ["x"], Echo()).count() == 0


def test_answers_go_on_where_a_model_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good", 2), (2, "bad one", 1), (3, None, 0)], "query_id int, prompt string, chunk_count int")
    out = {r.query_id: r for r in context.answers(rows, models.Resident(lambda: Counting(tmp_path, fails=("bad",)), "m")).collect()}
    assert (out[1].answer, out[1].error, out[1].metadata.model) == ("GOOD", None, "m")
    assert out[2].answer is None and out[2].error == "RuntimeError: no answer" and out[3].answer is None and out[3].error is None


def test_ingestion_with_a_model_that_fails_at_times(spark, tmp_path):
    docs = spark.createDataFrame([("A", "## ABSTRACT\nOne steel.\n"), ("B", "## ABSTRACT\nBroken steel.\n")], "doc_id string, text string")

    def make():
        def answer(items):
            if any("Broken" in x for x in items):
                raise RuntimeError("no answer")
            return [json.dumps({"properties": [{"name": "gloss", "value": 3}]}) for _ in items]

        return answer

    found = ingest.ingested(docs, answers=models.extracting(models.Resident(make))).mentions
    assert {(r.doc_id, r.name) for r in found.filter("extractor = -1").collect()} == {("A", "gloss")}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "EP1.md").write_text("## ABSTRACT\nOne steel.\n")
    with pytest.raises(SystemExit, match="needs a model"):
        ingest.main(["--folder", str(folder), "--output", str(tmp_path / "none"), "--use-llm-extraction"], spark=spark)
    told = ingest.main(["--folder", str(folder), "--output", str(tmp_path / "out"), "--use-llm-extraction"], spark=spark, model=models.Resident(make))
    assert told["entities"] == 1


def test_reranking_is_part_of_retrieval_by_settings(spark):
    texts = {"A": "core loss of silicon steel", "B": "core loss loss loss", "C": "stainless steel and core"}
    c = ingest.ingested(spark.createDataFrame([(k, f"## ABSTRACT\n{x}\n") for k, x in texts.items()], "doc_id string, text string"))
    asked = spark.createDataFrame([(1, "core loss")], "query_id int, text string")
    vecs = c.chunks.select("chunk_id", encoded(F.col("content"), HashedWords()).alias("embedding"))
    qvecs = asked.select("query_id", encoded(F.col("text"), HashedWords()).alias("embedding"))
    run = lambda settings, **more: [r.doc_id for r in ingest.ranked(c, asked, vecs, qvecs, settings, **more).orderBy("final_rank").collect()]
    plain = run(config.Settings())

    def scores(pairs):
        if any("stainless" in held for _, held in pairs):
            raise RuntimeError("no score")
        return [1.0 if "silicon" in held else 2.0 for _, held in pairs]

    assert set(plain) == {"A", "B", "C"} and len(run(config.Settings(reranker=True))) == 3
    assert run(config.Settings(reranker=True), scorer=scores) == ["B", "A", "C"]  # what fails comes last


def test_metrics_by_rank(spark):
    hits = {1: "abcd", 2: "xyz", 3: "dcba"}
    good = {1: "bd", 3: "dq", 4: "a"}
    rows = spark.createDataFrame([(q, c, k + 1) for q, cs in hits.items() for k, c in enumerate(cs)], "query_id int, chunk_id string, final_rank int")
    relevant = spark.createDataFrame([(q, c) for q, cs in good.items() for c in cs] + [(1, "b")], "query_id int, chunk_id string")
    expected = {}
    for q in {*hits, *good}:
        marks = [c in good.get(q, "") for c in hits.get(q, "")][:3]
        n, wanted = sum(marks), len(good.get(q, ""))
        precision = sum(sum(marks[: i + 1]) / (i + 1) for i, m in enumerate(marks) if m) / n if n else 0.0
        dcg, ideal = sum(1 / math.log2(i + 2) for i, m in enumerate(marks) if m), sum(1 / math.log2(i + 2) for i in range(min(3, wanted)))
        expected[q] = tuple(round(x, 6) for x in (precision, n / wanted if wanted else 0.0, 1 / (marks.index(True) + 1) if n else 0.0, dcg / ideal if ideal else 0.0))
    got = evaluate.ranked_metrics(rows, relevant, 3)
    assert {r.query_id: (r.context_precision, r.recall, r.mrr, r.ndcg) for r in got.collect()} == expected


def test_metrics_by_a_judge(spark):
    rows = [
        (1, "q", "It is hot. It is blue! Is it?", ["hot", "x", "blue and hot"]), (2, "q", "Gone.", ["broken", "x"]), (3, "q", None, ["q"]), (4, "q", "It is hot.", []),
    ]
    details = spark.createDataFrame(rows, "query_id int, question string, ground_truth string, contexts array<string>")

    def judge(pairs):
        if any("broken" in held for _, held in pairs):
            raise RuntimeError("no mark")
        return [1.0 if any(w.strip(".!?") in held.split() for w in asked.split()) or (asked == "q" and held != "x") else 0.0 for asked, held in pairs]

    out = evaluate.judged(details, judge)
    got = {r.query_id: (r.context_precision, r.context_recall) for r in out.collect()}
    assert got == {1: (round((1 + 2 / 3) / 2, 6), round(2 / 3, 6)), 2: (None, None), 3: (1.0, None), 4: (None, None)}
    means = {r.metric: r["mean"] for r in evaluate.metric_means(evaluate.scores(out)).collect()}
    assert means == {"context_precision": round((got[1][0] + 1.0) / 2, 6), "context_recall": got[1][1]}
