"""Source divergence audit by sorted runs of (lang, term, source, document).

A task sorts the words of the texts it reads by language, source, term and document; the
lengths of the runs are term counts, their number document frequencies. What several tasks
found of a (lang, term, source) is summed, dealt out by (lang, term) and sorted by source,
so that a term's sources pass as one run, however frequent it is. A first scan of these
runs keeps the terms of at least ``least`` documents of the language; a second one, when
the totals and so the shares p are known, emits per task the best terms of each source and
what the run adds to each pair of sources.

A pair of sources a, b adds f(p_a, p_b) for every kept term of the language, most of which
occur in few sources. With z the share of a term that a source lacks, the sum is

    V f(z_a, z_b) + sum over terms of a of f(p_a, z_b) - f(z_a, z_b), likewise of b,
    + sum over terms of both of f(p_a, p_b) - f(p_a, z_b) - f(z_a, p_b) + f(z_a, z_b)

Only the last sum needs the runs, and only sources present in one; the second needs how
often a source has each share. All arithmetic is on integers.

Edge cases: null texts, languages and sources are empty strings; a row is a document,
repeated ids and rows count each; texts without terms still give their (lang, source); a
language without kept terms has pairs of value 0 and no terms; a source alone in its
language has no pairs; ties are ranked by item; a very long text is lexed in blocks, a
very long term is one; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .text import Lexer, Memo, pieces, trim

SEPARATORS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LEAST, TOP = 10, 10
#: Counts and pair sums that a task holds before it sends them on.
HELD = 1 << 20
ROWS = 1 << 15


class Sums:
    """Sums of int64 columns by key, as sorted arrays; merged whenever twice as many came in."""

    def __init__(self):
        self.parts, self.n, self.merged = [], 0, 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, *values))
        self.n += len(keys)
        if self.n > max(HELD, 2 * self.merged):
            self.merge()

    def merge(self):
        keys, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
        out = (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))
        self.parts, self.n, self.merged = [out], len(first), len(first)
        return out

    def pop(self):
        out = self.merge() if self.parts else None
        self.parts, self.n, self.merged = [], 0, 0
        return out


def _lengths(sorted_keys: np.ndarray):
    """(first places, lengths) of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])[: len(sorted_keys)]
    return first, np.diff(np.r_[first, len(sorted_keys)])


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, df, n``: documents with a term and its occurrences, partial sums of tasks; a null term for each (lang, source) itself."""

    def run(batches):
        lexer, memo, terms, groups, sums = Lexer(SEPARATORS), Memo(HELD), [], {}, Sums()

        def sent():
            held = sums.pop()
            if held is not None:
                keys, df, n = held
                names, words = list(groups), pa.array(terms, pa.large_string())
                for a in range(0, len(keys), ROWS):
                    own = slice(a, a + ROWS)
                    of = (keys[own] >> 32).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[g][0] for g in of], pa.string()), pa.array([names[g][1] for g in of], pa.string()), words.take(pa.array(keys[own] & 0xFFFFFFFF)).cast(pa.string()), pa.array(df[own]), pa.array(n[own])], names=["lang", "source", "term", "df", "n"]
                    )

        for part in pieces(batches):
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
            words = lexer(part.column("text"))
            if not len(words.hashes):
                continue
            new, at = np.unique(words.hashes, return_index=True)
            at = at[memo.find(new) < 0]
            if memo.full(len(at)) or sums.n > 4 * HELD:
                yield from sent()
                memo.clear()
                terms.clear()
                at = np.unique(words.hashes, return_index=True)[1]
            memo.add(words.hashes[at])
            terms += [words.bytes_of(k).decode() for k in at.tolist()]
            # runs of (document, term), then of (lang and source, term) over documents
            keys = np.sort(words.rows.astype(np.int64) << 32 | memo.find(words.hashes))
            first, length = _lengths(keys)
            keys = group[keys[first] >> 32] << 32 | (keys[first] & 0xFFFFFFFF)
            sums.add(keys, np.ones(len(keys), np.int64), length)
        yield from sent()
        if groups:
            none = [0] * len(groups)
            yield pa.RecordBatch.from_pydict({"lang": [g[0] for g in groups], "source": [g[1] for g in groups], "term": pa.nulls(len(groups), pa.string()), "df": none, "n": none})
        del lexer, memo, terms, groups, sums
        trim()

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select("text", empty("lang"), empty("source")).mapInArrow(run, "lang string, source string, term string, df long, n long")


def _runs(batches):
    """Tables of whole runs of (lang, term) from sorted batches, with the first places of the runs."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in ("lang", "term"):
            column = rows.column(name).combine_chunks()
            null = column.is_null().to_numpy(zero_copy_only=False)
            same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | null[1:] & null[:-1])
        first = np.flatnonzero(new)
        rest = rows.slice(first[-1])
        if first[-1]:
            yield rows.slice(0, first[-1]).combine_chunks(), first[:-1]
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """First scan: ``lang, term, source, n, total, first`` of the terms in at least ``least`` documents of their language.

    total: occurrences in the language; first: 1 in one row of each term. Rows of null terms, one a source, stay.
    """

    def scan(batches):
        for rows, first in _runs(batches):
            length = np.diff(np.r_[first, rows.num_rows])
            df, n = (rows.column(c).combine_chunks().to_numpy() for c in ("df", "n"))
            named = rows.column("term").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            keep = np.repeat(np.add.reduceat(df, first) >= least, length) | ~named
            head = np.zeros(rows.num_rows, np.int64)
            head[first] = named[first]
            out = rows.select(["lang", "term", "source", "n"]).append_column("total", pa.array(np.repeat(np.add.reduceat(n, first), length))).append_column("first", pa.array(head))
            yield from out.filter(pa.array(keep)).to_batches(ROWS)

    summed = counts.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return summed.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, "lang string, term string, source string, n long, total long, first long")


def share(count, denominator):
    """1 + floor(1000000000 * (count + 2) / denominator), exact; null for a language without terms."""
    return F.expr(f"1 + (1000000000BD * ({count} + 2)) div nullif(cast({denominator} as decimal(19, 0)), 0)")


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pairs(n: int):
    """Places i < j of n, in blocks."""
    if n <= 1024:
        yield np.triu_indices(n, 1)
        return
    for i in range(n - 1):
        yield np.full(n - 1 - i, i), np.arange(i + 1, n)


def scanned(runs: DataFrame, top: int = TOP) -> DataFrame:
    """Second scan, over ``lang, term, source, p, q, z``: a task's best terms of each source, and sums over terms of two sources of a pair.

    ``part`` is ``term`` or ``pair``; the first source of a pair is the lesser.
    """

    def scan(batches):
        groups, names, best, sums, seen = {}, [], {}, Sums(), 0

        def sent():
            held = sums.pop()
            if held is not None:
                for a in range(0, len(held[0]), ROWS):
                    key = held[0][a : a + ROWS]
                    left, right = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
                    yield pa.RecordBatch.from_pydict({"part": ["pair"] * len(key), "lang": [names[g][0] for g in left], "source": [names[g][1] for g in left], "item": [names[g][1] for g in right], "value": held[1][a : a + ROWS]})

        for rows, first in _runs(batches):
            length = np.diff(np.r_[first, rows.num_rows])
            p, q, z = (rows.column(c).combine_chunks().to_numpy() for c in ("p", "q", "z"))
            lang, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            both = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            own, back = np.unique(both, return_inverse=True)
            for k in own.tolist():
                name = lang.dictionary[k // len(source.dictionary)].as_py(), source.dictionary[k % len(source.dictionary)].as_py()
                if name not in groups:
                    groups[name] = len(names)
                    names.append(name)
            number = np.array([groups[lang.dictionary[k // len(source.dictionary)].as_py(), source.dictionary[k % len(source.dictionary)].as_py()] for k in own.tolist()], np.int64)
            group = number[back]
            # terms of one language come in order, so that of equal values the earlier is the lesser
            over = np.flatnonzero(p > q)
            value = _distance(p[over], q[over])
            order = np.lexsort((over, -value, group[over]))
            begin, n = _lengths(group[over][order])
            place = np.arange(len(order)) - np.repeat(begin, n)
            order = order[place < top]
            words = rows.column("term").take(pa.array(over[order])).to_pylist()
            for g, v, at, word in zip(group[over][order].tolist(), value[order].tolist(), over[order].tolist(), words, strict=True):
                best.setdefault(g, []).append((-v, seen + at, word))
            for g in set(group[over][order].tolist()):
                best[g] = sorted(best[g])[:top]
            seen += rows.num_rows
            for k in np.unique(length[length > 1]).tolist():
                begin = first[length == k]
                for i, j in _pairs(k):
                    step = max(1, HELD // max(1, len(i)))
                    for a in range(0, len(begin), step):
                        x, y = ((begin[a : a + step, None] + w[None, :]).ravel() for w in (i, j))
                        sums.add(group[x] << 32 | group[y], _distance(p[x], p[y]) - _distance(p[x], z[y]) - _distance(z[x], p[y]) + _distance(z[x], z[y]))
            if sums.n > 4 * HELD:
                yield from sent()
        yield from sent()
        rows = [(*names[g], word, -v) for g, own in best.items() for v, _, word in own]
        if rows:
            lang, source, item, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"part": ["term"] * len(rows), "lang": lang, "source": source, "item": item, "value": pa.array(value, pa.int64())})

    rows = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").select("lang", "term", "source", "p", "q", "z")
    return rows.mapInArrow(scan, "part string, lang string, source string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distance to the others of its language, and the terms it has most beyond its language."""
    kept = shared.table(kept_terms(counted(docs), least), "divergence-terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("v").alias("terms"))
    groups = groups.join(langs, "lang").select("lang", "source", "terms", (F.col("n") + 2 * F.col("terms")).alias("under"), (F.col("total") + 2 * F.col("terms")).alias("under_all"))
    groups = shared.small(groups.withColumn("z", share("0L", "under")), "divergence-sources")
    runs = kept.filter("term is not null").join(groups, ["lang", "source"]).select("lang", "term", "source", share("n", "under").alias("p"), share("total", "under_all").alias("q"), "z")
    found = shared.table(scanned(runs, top), "divergence-partial")
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    pairs = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.expr(f"terms * ({distance('z', 'other')})"), F.lit(0)).alias("value"))
    shares = runs.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("n"))
    single = shares.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"n * ({distance('p', 'other')} - {distance('z', 'other')})").alias("value"))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one_way = single.unionByName(found.filter("part = 'pair'").drop("part"))
    mirrored = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = pairs.unionByName(one_way).unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT lang, source, term, rid, count(*) AS n FROM
  (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
terms AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(*) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM terms GROUP BY lang),
grid AS (SELECT g.lang, g.source, t.term, t.total, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN terms t USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p,
  1 + 1000000000 * (total + 2) // (all_n + 2 * v) AS q FROM grid JOIN (SELECT lang, v, n AS all_n FROM langs) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
best AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM
  (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM best) WHERE rank <= 10
"""
