"""Exact inner-product search over normalised vectors, in blocks of rows and of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm

QUERY_BLOCK = 4096
ROW_BLOCK = 1 << 17


def normalised(vectors: DataFrame, column: str = "embedding", epsilon: float = 0.0) -> DataFrame:
    """I4: vectors by their norm and ``epsilon``; a zero vector stays zero instead of becoming NaN. Null vectors and ones that hold a null go."""
    whole = vectors.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull()))
    n = norm(F.col(column))
    return whole.withColumn(column, F.transform(column, lambda x: F.when(n > 0, x.cast("double") / (n + epsilon)).otherwise(F.lit(0.0))))


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places and the rows of the vectors of that length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
    return out


def _best(asked: dict, ids: pa.Array, rows: pa.RecordBatch, top_k: int, threshold: float | None):
    """The best ``top_k`` of a batch for each query, with all that tie with the last."""
    for size, (at, matrix) in _matrices(rows.column("embedding")).items():
        if size not in asked:
            continue
        places, queries = asked[size]
        score = np.round(queries @ matrix.T, 9)
        k = min(top_k, len(at))
        worst = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        q, c = np.nonzero(score >= (worst if threshold is None else np.maximum(worst, threshold))[:, None])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[q])), rows.column("chunk_id").take(pa.array(at[c])), pa.array(score[q, c])], names=["query_id", "chunk_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float | None = None, epsilon: float = 0.0) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of ``vectors (chunk_id, embedding)`` for ``queries (query_id, embedding)``.

    Each batch of rows meets a block of queries as one matrix product and sends on its
    best ``top_k`` per query, so what is shuffled doesn't grow with the dimension. Up to
    ``QUERY_BLOCK`` queries (they are counted) go to every task; more are dealt into blocks
    that meet blocks of rows, each pair in a task's group. Ties go by chunk id. A vector
    that is null, holds a null or has another length than the query's is no hit.
    """
    asked, unit = (normalised(df, epsilon=epsilon).select(c, "embedding") for df, c in ((queries, "query_id"), (vectors, "chunk_id")))
    kinds = {c: dict(df.dtypes)[c] for df, c in ((asked, "query_id"), (unit, "chunk_id"))}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", score double"
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        first = first.combine_chunks()
        ids = pa.concat_arrays(first.column("query_id").chunks) if first.num_rows else pa.nulls(0)
        block = _matrices(pa.concat_arrays(first.column("embedding").chunks)) if first.num_rows else {}

        def run(batches):
            for b in batches:
                yield from _best(block, ids, b, top_k, threshold)

        out = unit.mapInArrow(run, schema)
    else:
        blocks = lambda df, n: max(1, -(-df.count() // n))
        nq, nv = blocks(asked, QUERY_BLOCK // 2), blocks(unit, ROW_BLOCK)
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("i", place("query_id", nq)).withColumn("j", every(nv))
        right = unit.withColumn("j", place("chunk_id", nv)).withColumn("i", every(nq))

        def met(q: pa.Table, v: pa.Table) -> pa.Table:
            found = []
            if q.num_rows and v.num_rows:
                ids, block = q.column("query_id").combine_chunks(), _matrices(q.column("embedding").combine_chunks())
                found = [x for b in v.combine_chunks().to_batches(4096) for x in _best(block, ids, b.select(["chunk_id", "embedding"]), top_k, threshold)]
            types = [q.schema.field("query_id").type, v.schema.field("chunk_id").type, pa.float64()]
            return pa.Table.from_batches(found, pa.schema(list(zip(["query_id", "chunk_id", "score"], types, strict=True))))

        out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(met, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top_k)
