"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item gives its windows of 13 consecutive words (an item of fewer words is one
window). Windows of one length m are searched together: the block of two words that ends
at a position of the text looks up how far from it a test window can end at the nearest,
and that many positions are skipped (unknown words skip the most); where the shift is 0,
the hash of that block, narrowed by the window's first words, selects a bucket of test
windows, and each is compared with the text word by word. The lanes of a span of ``SPAN``
words advance together, each by its own shifts. Occurrences mark their words in an array of
differences, and pairs of row and item are numbers, so many of them cost no objects.

What a worker holds of the items are sorted arrays: the words' numbers, and for a window
its place among them, its bucket and its item, about ``HELD`` bytes a byte of text. The
items go to every worker only after their size is checked: up to ``ITEM_BYTES`` of text
at once. Beyond it they are searched in blocks of that size, one pass over the documents
each, and the spans of the passes are united, with the same result.

Edge cases: null or empty texts have no words, no hits and the sha256 of the empty list;
items without words are never found; equal items with different ids are all reported;
equal rows are judged alike; an empty table of documents gives no rows, an empty table of
items no hits; a very long text is searched span by span; columns of the input beyond id
and text, whatever their names, don't matter, and ``clean`` passes them through.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import NOT_ALNUM, Lexer, joined, once, slices

WINDOW = 13
ITEM_BYTES = 8 << 20
HELD = 20
SPAN = 1 << 16
#: Words of a text that are searched one after another, beside other such lanes.
LANE = 128
SCHEMA = "row long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def blocks_of(words: np.ndarray, size: int, m: int, at: np.ndarray) -> np.ndarray:
    """The number of the block of words that ends at each place ``at``: of two words, or for windows of one word of that alone."""
    last = words[at].astype(np.int64)
    return last if m == 1 else words[at - 1].astype(np.int64) * size + last


class WuManber:
    """Windows of ``m`` words: places in ``words``, the numbers of all items' words, each item's after a -1."""

    def __init__(self, m: int, words: np.ndarray, places: np.ndarray, items: np.ndarray, size: int):
        self.m, self.words, self.size, self.block = m, words, size, min(2, m)
        #: Places of texts that were looked up.
        self.read = 0
        # the shift of a block: how far before the end of some window it stands, at the least
        codes = [blocks_of(words, size, m, places + end - 1) for end in range(self.block, m + 1)]
        self.blocks = np.unique(np.concatenate(codes))
        self.shift = np.full(len(self.blocks), m, np.int32)
        for end, own in zip(range(self.block, m + 1), codes, strict=True):
            at = np.searchsorted(self.blocks, own)
            self.shift[at] = np.minimum(self.shift[at], m - end)  # the same end for all of own
        bucket = self.bucket(codes[-1], codes[0])
        order = np.argsort(bucket, kind="stable")
        self.buckets, self.places, self.items = bucket[order], places[order].astype(np.int32), items[order].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.blocks, self.shift, self.buckets, self.places, self.items))

    @staticmethod
    def bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The hash of a window's last and first block."""
        return joined(last.astype(np.uint64), first.astype(np.uint64))

    def search(self, text: np.ndarray):
        """(begins, items) of the occurrences in a text that starts with a -1; words that no item has are -1."""
        m = self.m
        if len(text) <= m or not len(self.blocks):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        at = np.arange(m, len(text), LANE)
        stop, last = np.minimum(at + LANE, len(text)), []
        while len(at):
            self.read += len(at)
            block = blocks_of(text, self.size, m, at)
            place = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
            unknown = (text[at] < 0) | (text[at - self.block + 1] < 0)
            # no window holds an unknown word, and none the block unless it is in the table
            shift = np.where(text[at] < 0, m, np.where(unknown | (self.blocks[place] != block), m - self.block + 1, self.shift[place]))
            last.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            at, stop = at[at < stop], stop[at < stop]
        last = np.sort(np.concatenate(last))
        first = last - (m - self.block)
        known = (text[first] >= 0) & (text[first - self.block + 1] >= 0)
        last, first = last[known], first[known]
        bucket = self.bucket(blocks_of(text, self.size, m, last), blocks_of(text, self.size, m, first))
        low = np.searchsorted(self.buckets, bucket)
        n = np.searchsorted(self.buckets, bucket, "right") - low
        # each candidate with each window of its bucket, compared word by word
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begin = np.repeat(last, n) + 1 - m
        same = np.ones(len(which), bool)
        for k in range(m):
            same &= text[begin + k] == self.words[self.places[which] + k]
        return begin[same], self.items[which[same]]


class Matcher:
    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.lexer = Lexer(NOT_ALNUM)
        self.ids, self.number = np.unique(np.array([i for i, _ in items], dtype=object), return_inverse=True) if items else (np.empty(0, object), np.empty(0, np.int64))
        words = self.lexer(pa.array([t for _, t in items], pa.string()))
        self.known, numbers = np.unique(words.hashes, return_inverse=True)
        counts = words.counts
        every = np.insert(numbers.astype(np.int32), words.docs[:-1], -1)
        begins = words.docs[:-1] + np.arange(1, len(items) + 1)
        length = np.minimum(window, counts)
        self.engines = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            n = counts[own] - m + 1
            item = np.repeat(own, n)
            places = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.engines.append(WuManber(m, every, places, item, len(self.known) + 1))

    @property
    def nbytes(self) -> int:
        return self.known.nbytes + sum(e.nbytes for e in self.engines) + max((e.words.nbytes for e in self.engines), default=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1).astype(np.int32)

    def find(self, texts: pa.Array):
        """(words of each text, row and place of the first word of each span, its end, row and item of each item found).

        Spans are united and in order, items are numbers into ``ids``, in order and once a row.
        """
        words = self.lexer(texts)
        # all texts in a row, each after a -1, so that no window goes from one to the next
        every = np.insert(self.numbers(words.hashes), words.docs[:-1], -1)
        starts = words.docs[:-1] + np.arange(len(texts))
        step, pairs = np.zeros(len(every) + 1, np.int32), []
        for engine in self.engines:
            for a in range(0, len(every), SPAN):
                begin, item = engine.search(every[a : a + SPAN + engine.m])
                row = np.searchsorted(starts, begin + a, "right") - 1
                pairs.append(np.unique(row << 32 | self.number[item]))
                begin = np.unique(begin) + a
                step[begin] += 1
                step[begin + engine.m] -= 1
        hit = np.diff(np.cumsum(step[:-1], dtype=np.int32) > 0, prepend=False, append=False)
        edges = np.flatnonzero(hit)
        begin, end = edges[::2], edges[1::2]
        row = np.searchsorted(starts, begin, "right") - 1
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return words.counts, row, begin - starts[row] - 1, end - starts[row] - 1, pairs >> 32, pairs & 0xFFFFFFFF

    def __call__(self, texts: pa.Array):
        """(words, spans, items) of each text."""
        counts, row, begin, end, of, item = self.find(texts)
        for k, n in enumerate(counts.tolist()):
            own, some = slice(*np.searchsorted(row, [k, k + 1])), slice(*np.searchsorted(of, [k, k + 1]))
            yield n, list(zip(begin[own].tolist(), end[own].tolist(), strict=True)), self.ids[item[some]].tolist()


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """The values of ``n`` rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _spans(begin: np.ndarray, end: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])


def united_lists(lists: pa.Array) -> pa.Array:
    """The spans of several passes over each text, united and in order."""
    n = len(lists)
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    begin, end = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order] | row[order] << 32, end[order] | row[order] << 32
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])[: len(row)]
    last = np.r_[first[1:], len(row)] - 1 if len(first) else first
    return _lists(row[first], n, _spans(begin[first] & 0xFFFFFFFF, reach[last] & 0xFFFFFFFF))


def united(spans: Column) -> Column:
    return F.arrow_udf(united_lists, "array<struct<start:int,end:int>>")(spans)


def _pass(docs: DataFrame, items: list, window: int) -> DataFrame:
    held, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        matcher = once(key, lambda: Matcher(held.value, window))
        for part in slices(batches):
            counts, row, begin, end, of, item = matcher.find(part.column("text"))
            spans = _lists(row, len(counts), _spans(begin, end))
            items = _lists(of, len(counts), pa.array(matcher.ids[item].tolist(), pa.string()))
            columns = [part.column("row"), part.column("doc_id"), pa.array(counts, pa.int64()), spans, items]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, SCHEMA)


def item_blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> list:
    """Loaders of the items' (id, text), each of about ``item_bytes`` at most by a count of the text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = math.ceil(total / item_bytes) or 1
    if blocks > 1:
        items = shared.table(items, "decontaminate-items")
    of = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [lambda k=k: [tuple(r) for r in (items if blocks == 1 else items.filter(of == k)).collect()] for k in range(blocks)]


def _united(rows: DataFrame, blocks: list, window: int) -> DataFrame:
    """A pass over the rows for each block of items; a row's spans and items of all passes are united."""
    out = None
    for load in blocks:
        own = shared.table(_pass(rows, load(), window), "decontaminate-pass")
        out = own if out is None else out.unionByName(own)
    spans, items = F.flatten(F.collect_list("spans")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    merged = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))
    return merged.withColumn("spans", united(F.col("spans")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row: united spans of hit words, [start, end), and the ids of the items found."""
    blocks = item_blocks(benchmark, item_bytes)
    if len(blocks) == 1:
        return _pass(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), blocks[0](), window).drop("row")
    rows = shared.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate-rows")
    return _united(rows, blocks, window).drop("row")


def judged(found: DataFrame) -> DataFrame:
    """The digest columns and the verdict: a hit, and at least a twentieth of the words hit."""
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    blocks = item_blocks(benchmark, item_bytes)
    if len(blocks) > 1:
        work = shared.fresh(docs, "row")
        rows = shared.table(docs.withColumn(work, F.monotonically_increasing_id()), "decontaminate-docs")
        bad = judged(_united(rows.select(F.col(work).alias("row"), "doc_id", "text"), blocks, window)).filter("contaminated")
        return rows.join(bad.select(F.col("row").alias(work)), work, "left_anti").select(*docs.columns)
    held, key = docs.sparkSession.sparkContext.broadcast(blocks[0]()), uuid.uuid4().hex

    def run(batches):
        matcher = once(key, lambda: Matcher(held.value, window))
        for part in slices(batches):
            counts, row, begin, end, _, _ = matcher.find(part.column("text"))
            hit = np.bincount(row, end - begin, len(counts)).astype(np.int64)
            yield part.filter(pa.array(~((hit > 0) & (20 * hit >= counts)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return judged(hits(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
it AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w))::INT AS m FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM
  (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT rid, dw.m, i, item_id FROM dw JOIN win USING (m, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM occ) GROUP BY rid),
ids AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""
