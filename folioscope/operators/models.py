"""Outside models as operators that live in their workers.

A worker makes a model when it first needs it and keeps it for its life; only the function
that makes it is shipped. Equal inputs are asked once, in batches; a batch that fails is
tried again and then item by item, and an item that still fails is a row with an error in
place of a result, so that one bad input doesn't end a job. What was answered is a stage
table: a task that is run again later reads it and asks nothing twice, and answers kept
from before (``known``) aren't asked for again.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

BATCH, TRIES = 32, 2
_TYPES = {"string": pa.string(), "double": pa.float64()}
_LOADED: dict[str, object] = {}


class Resident:
    """A model, any callable from a list of inputs to a list of results, by the function that makes it."""

    def __init__(self, make, name: str | None = None):
        self.make, self.name, self.key = make, name or getattr(make, "__name__", "model"), uuid.uuid4().hex

    def __call__(self, items: list):
        if self.key not in _LOADED:
            _LOADED[self.key] = self.make()
        return _LOADED[self.key](items)


def resident(model) -> Resident:
    """A model that is at hand, as one that is made where it is needed."""
    return model if isinstance(model, Resident) else Resident(lambda: model, getattr(model, "name", type(model).__name__))


def _tried(model, items: list, tries: int) -> tuple[list | None, str | None]:
    error = None
    for _ in range(tries):
        try:
            out = list(model(items))
            if len(out) == len(items):
                return out, None
            error = f"ValueError: {len(out)} results for {len(items)} inputs"
        except Exception as e:  # whatever a model's library raises
            error = f"{type(e).__name__}: {e}"
    return None, error


def _results(model, items: list, tries: int):
    """(result, error) of each item."""
    out, error = _tried(model, items, tries)
    if out is not None:
        return [(x, None) for x in out]
    if len(items) == 1:
        return [(None, error)]
    return [_results(model, [x], tries)[0] for x in items]


def called(rows: DataFrame, inputs: list[str], model, kind: str = "string", batch: int = BATCH, tries: int = TRIES, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``key, result, error``: a model of one input gets strings, of several tuples; rows with a null input have neither result nor error.

    ``known (key, result)`` are results that were kept; those of errors aren't kept.
    """
    model, kept = resident(model), scratch.table(rows.withColumn("key", F.when(F.concat(*inputs).isNotNull(), F.sha2(F.to_json(F.struct(*inputs)), 256))), "model-inputs")
    asked = kept.filter("key is not null").select("key", *inputs).dropDuplicates(["key"])
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, batch):
                some = b.slice(a, batch)
                columns = [some.column(c).to_pylist() for c in inputs]
                found = _results(model, columns[0] if len(columns) == 1 else list(zip(*columns, strict=True)), tries)
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array([x for x, _ in found], _TYPES[kind]), pa.array([e for _, e in found], pa.string())], names=["key", "result", "error"])

    results = scratch.table(asked.mapInArrow(run, f"key string, result {kind}, error string"), "model-results")
    if known is not None:
        results = results.unionByName(known.select("key", "result", F.lit(None).cast("string").alias("error")))
    return kept.join(results, "key", "left")


def kept(called: DataFrame) -> DataFrame:
    """``key, result`` of what was answered, to be ``known`` another time."""
    return called.filter("key is not null and error is null").select("key", "result").dropDuplicates(["key"])


def extracting(model, **options):
    """From chunks to a model's answers, for ``ingest.ingested``; a chunk that the model fails on gives no mentions."""

    def answers(chunks: DataFrame) -> DataFrame:
        return called(chunks.select("chunk_id", "doc_id", "seq", "content"), ["content"], model, **options).select("chunk_id", "doc_id", "seq", F.col("result").alias("answer"))

    return answers


def pair_scored(fused: DataFrame, model, top_n: int, question: str = "text", content: str = "content", **options) -> DataFrame:
    """The best ``top_n`` of each question with ``rerank_score`` by a model of (question, chunk) pairs; where it fails a hit keeps the least score."""
    out = called(fused.filter(F.col("rrf_rank") <= top_n), [question, content], model, "double", **options)
    return out.withColumn("rerank_score", F.round(F.coalesce("result", F.lit(float("-inf"))), 9)).drop("key", "result", "error")
