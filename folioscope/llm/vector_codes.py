"""Codes of vectors by parts, with codebooks that a metric tree searches.

A vector of integers is cut into ``PARTS`` equal parts; each position has a codebook that
starts as the parts of the ``ENTRIES`` least ids and is moved ``ROUNDS`` times to the means
(rounded down) of the parts nearest to its entries. A codebook is searched by a
vantage-point tree: a node's entries lie within a range of distances from its vantage
entry, and by the triangle inequality a query skips those that can't be as near as the
best entry so far. Radii and distances are rounded away from skipping by 2**-50 of their
size, a node that may hold an equally near entry is visited, and what is compared in the
end are squared distances as integers, the lesser index among equal ones; so the result is
that of comparing all entries. Integers are held as doubles where all sums stay under
2**53, else as Python's.

A task sums the parts of each entry over its rows; what goes to the driver are at most
``PARTS * ENTRIES`` rows of means, whatever the table's size.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped,
as are those whose length isn't that of the first by id, of those that can be cut;
components beyond 64 bits count as the nearest integer within, errors beyond as the largest;
null ids come after all others and equal ids are ordered by their vectors, and each row is
a row of the result; with fewer rows than entries the codebooks are that small; equal
entries lose all parts to the first of them and stay; an empty table gives no rows; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import trim

PARTS, ENTRIES, ROUNDS = 4, 256, 4
LEAF = 16
#: Rows that are searched together.
ROWS = 1 << 13
MOST = (1 << 63) - 1
LESS, MORE = 1 - 2.0**-50, 1 + 2.0**-50


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all entries, exact."""
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def held_as(*arrays: np.ndarray):
    """float64 where each sum in ``distances`` of these integers is exact in it, else object."""
    most = max((max(abs(int(x.max())), abs(int(x.min()))) for x in arrays if x.size), default=0)
    width = max((x.shape[1] for x in arrays), default=1)
    return np.float64 if 4 * most * most * width < 1 << 53 else object


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Tree:
    """A vantage-point tree over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own
        far = own[int(np.argmax(distances(self.entries[own[:1]], self.entries[own])[0]))]
        rest = own[own != far]
        square = distances(self.entries[[far]], self.entries[rest])[0]
        order = np.argsort(square, kind="stable")
        halves, radius = np.array_split(order, 2), roots(square)
        children = [(self._node(np.sort(rest[h])), radius[h].min() * LESS, radius[h].max() * MORE) for h in halves]
        return far, children, square[halves[0]].max()

    def nearest(self, rows: np.ndarray):
        """(indices of the nearest entries, the least among equal ones; squared distances)."""
        # no entry is farther than the first
        self.rows, self.best = rows, distances(rows, self.entries[:1])[:, 0]
        self.at = np.zeros(len(rows), np.int64)
        self.met = 0
        self._visit(self.root, np.arange(len(rows)))
        return self.at, self.best

    def _better(self, who: np.ndarray, square: np.ndarray, at) -> None:
        self.met += len(who)
        better = (square < self.best[who]) | ((square == self.best[who]) & (at < self.at[who]))
        self.best[who[better]] = square[better]
        self.at[who[better]] = at[better] if isinstance(at, np.ndarray) else at

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            square = distances(self.rows[who], self.entries[node])
            least = square.argmin(axis=1)
            self.met += len(who) * (len(node) - 1)
            self._better(who, square[np.arange(len(who)), least], node[least])
            return
        far, children, inner = node
        square = distances(self.rows[who], self.entries[[far]])[:, 0]
        self._better(who, square, far)
        from_far, inside = roots(square), square <= inner
        for turn in (True, False):  # first each query's own side, then the other
            for side, (child, low, high) in zip((inside, ~inside), children, strict=True):
                own = np.flatnonzero(side == turn)
                bound = np.maximum(from_far[own] * LESS - high, low - from_far[own] * MORE) * LESS
                may = bound <= roots(self.best[who[own]]) * MORE
                self._visit(child, who[own[may]])


class Codebooks:
    """The trees of all part positions, built anew where a batch needs exact Python integers."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.trees = books, {}

    def __call__(self, rows: np.ndarray):
        """(indices, squared distances) of all parts of integer rows: a column each."""
        found = []
        width = rows.shape[1] // len(self.books)
        for k, book in enumerate(self.books):
            own = rows[:, k * width : (k + 1) * width]
            kind = held_as(own, book)
            if (k, kind) not in self.trees:
                self.trees[k, kind] = Tree(book.astype(kind))
            found.append(self.trees[k, kind].nearest(own.astype(kind)))
        return np.stack([x for x, _ in found], axis=1), [x for _, x in found]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the rows whose components are all finite, each as floor(1024 * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(2.0**63)
    whole = lambda x: F.when(x >= most, F.lit(MOST)).when(x <= -most, F.lit(-MOST - 1)).otherwise(F.floor(x))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", "label", F.transform("embedding", lambda x: whole(1024 * x.cast("double"))).alias("v"))


def _matrices(batches, *beside: str):
    """(rows of integers, the columns ``beside``) of bounded pieces of the batches."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            piece = batch.slice(a, ROWS)
            lists = piece.column("v")
            yield lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1), [piece.column(c) for c in beside]


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        search, sums = Codebooks(held.value), {}
        for matrix, _ in _matrices(batches):
            at, _ = search(matrix)
            width = matrix.shape[1] // len(search.books)
            for k in range(len(search.books)):
                order = np.argsort(at[:, k], kind="stable")
                entry, first, n = np.unique(at[order, k], return_index=True, return_counts=True)
                own = matrix[order, k * width : (k + 1) * width]
                own = np.add.reduceat(own if held_as(own) is np.float64 else own.astype(object), first, axis=0)
                for e, count, s in zip(entry.tolist(), n.tolist(), own.astype(object), strict=True):
                    old = sums.get((k, e))
                    sums[k, e] = (count, s) if old is None else (old[0] + count, old[1] + s)
        if sums:
            kind = pa.list_(pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((k, e, n, [Decimal(int(x)) for x in s]) for (k, e), (n, s) in sums.items()), strict=True), (pa.int32(), pa.int32(), pa.int64(), kind), strict=True)], names=["part", "entry", "n", "sums"])
        trim()

    width = books[0].shape[1]
    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = [book.copy() for book in books]
    for row in total.collect():  # at most one row an entry
        out[row["part"]][row["entry"]] = [int(x) // row["n"] for x in row["sums"]]
    held.unpersist()
    return out


def start(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The first codebooks: the parts of the least ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.split(np.array([r["v"] for r in first], np.int64), parts, axis=1)


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(``vec_id, label, code, error`` of every kept row, the codebooks): code is an array of entry numbers by part."""
    rows = integers(vectors)
    length = rows.filter(F.size("v") % parts == 0).filter(F.size("v") > 0).orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    schema = "vec_id long, label string, code array<int>, error long".replace("string", rows.schema["label"].dataType.simpleString()).replace("vec_id long", f"vec_id {rows.schema['vec_id'].dataType.simpleString()}")
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema), Codebooks([np.empty((0, 1), np.int64)] * parts)
    rows = shared.table(rows.filter(F.size("v") == length[0]), "codes-vectors")
    books = start(rows, parts, entries)
    for _ in range(rounds):
        books = moved(rows, books)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        search = Codebooks(held.value)
        for matrix, (ids, labels) in _matrices(batches, "vec_id", "label"):
            at, squares = search(matrix)
            error = [min(sum(int(x) for x in own), MOST) for own in zip(*squares, strict=True)]
            flat = pa.array(at.astype(np.int32).ravel())
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
        trim()

    return rows.mapInArrow(run, schema), Codebooks(books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together; labels are broadcast only if they are few."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy("label").agg(F.least(total, F.lit(Decimal(MOST))).cast("long").alias("label_error"))
    sums = shared.small(sums.withColumnRenamed("label", "of"), "codes-labels")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def hexadecimal(code: str) -> Column:
    return F.array_join(F.transform(code, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_error(shared.table(rows, "codes"))
    return rows.select("vec_id", hexadecimal("code").alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of the assignment to the codebooks c{n}, and of the codebooks after it."""
    return f"""
a{n} AS MATERIALIZED (SELECT rid, p, min(struct_pack(d := xx - 2 * list_inner_product(x, e) + ee, i := i)) AS a FROM parts JOIN c{n} USING (p) GROUP BY rid, p),
m{n} AS (SELECT p, i, list(m ORDER BY j) AS e FROM (SELECT p, a.i AS i, j, ((s - ((s % n + n) % n)) // n)::DOUBLE AS m FROM
  (SELECT p, a.i AS i, j, sum(x[j])::HUGEINT AS s, count(*) AS n, any_value(a) AS a FROM a{n} JOIN parts USING (rid, p), range(1, 1 + len(x)) t(j) GROUP BY p, a.i, j)) GROUP BY p, i),
c{n + 1} AS MATERIALIZED (SELECT p, i, e, list_inner_product(e, e) AS ee FROM (SELECT p, i, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN m{n} m USING (p, i))),"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM k, range(4) t(p))),
c0 AS MATERIALIZED (SELECT p, rid AS i, x AS e, xx AS ee FROM parts WHERE rid < 256),{"".join(_round(n) for n in range(ROUNDS))}
final AS (SELECT rid, p, min(struct_pack(d := xx - 2 * list_inner_product(x, e) + ee, i := i)) AS a FROM parts JOIN c{ROUNDS} USING (p) GROUP BY rid, p),
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(a.i)), 2, '0'), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM final GROUP BY rid),
sha AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM (SELECT p, i, j, e[j] AS x FROM c{ROUNDS}, range(1, 1 + len(e)) t(j)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN coded USING (rid), sha
"""
