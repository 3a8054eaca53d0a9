"""Removal of passages that an earlier document has, by winnowed anchors that are extended.

Of the ``WINDOW`` consecutive words of a window the least hash of ``GRAM`` consecutive ones
is its anchor, so equal windows have equal anchors. Consecutive windows of one anchor are a
segment: the anchor, extended both ways as far as it is the least. Every window lies in one
segment, and there is about one segment in (WINDOW - GRAM + 2) / 2 words.

Segments are joined by anchor; those whose anchor only one document has are done. Of the
others, equal segments (anchor and all words) are settled at once: whole in every document
but that of the least id. What that one keeps of them is compared with the unlike segments
of the same anchor: only for these, the windows around the anchor are hashed one by one, and
a window goes if a smaller document has it. Windows that touch unite to maximal repeats; the
words in these are removed. So neither all windows nor all pairs of an anchor's occurrences
are ever made: copies cost a row a segment, a frequent line its windows once a document.

Segments carry the document's id and a hash of its text. The text itself is joined to what
was found by these, for documents with common anchors only. An anchor or passage that a
large share of the documents has meets its few facts in a join by key whose large side
Spark can split; nothing gathers a key's rows.

Edge cases: null, blank and empty texts have no words; a document under ``WINDOW`` words
loses none; a null id is neither smaller nor greater than another, so such rows lose nothing
and take nothing from others; rows with equal ids aren't smaller than each other, and a
repeat within a document stays; equal rows have equal results; a very long text is lexed in
blocks and cut into spans; an empty table gives no rows; other columns, whatever their
names, aren't read. Windows are compared as hashes, of 64 bits beside the 64 of their anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import SPACE, Lexer, mix, pieces

WINDOW, GRAM = 50, 20
#: Words that are hashed together.
SPAN = 1 << 18
WHOLE, COMPARE = 1, 2

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 12), base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


class Grams:
    """Hashes of any consecutive words of a span, as differences of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, begin, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    held = 1
    while 2 * held <= width:
        values, held = np.minimum(values[:-held], values[held:]), 2 * held
    rest = width - held
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Segments:
    """The segments of one text: ``anchor`` and hash of each, its first window and its number of windows; ``same`` is the first segment equal to it."""

    def __init__(self, hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.hashes, self.window = hashes, window
        anchors, wholes, begins, lengths = [], [], [], []
        for a in range(0, max(0, len(hashes) - window + 1), SPAN):
            own = Grams(hashes[a : a + SPAN + window - 1])
            n = len(own.sums) - 1
            at = np.arange(n - gram + 1)
            anchor = least_of(own(at, at + gram), window - gram + 1)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            length = np.diff(np.r_[first, len(anchor)])
            anchors.append(anchor[first])
            wholes.append(own(first, first + length - 1 + window))
            begins.append(first + a)
            lengths.append(length)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.anchor, self.whole, self.begin, self.length = join(anchors, np.uint64), join(wholes, np.uint64), join(begins, np.int64), join(lengths, np.int64)
        order = np.lexsort((self.whole, self.anchor))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.anchor[order]) != 0) | (np.diff(self.whole[order]) != 0)
        # equal ones stand in order of place, as the sort is stable
        self.same = np.empty(len(order), np.int64)
        self.same[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order

    def windows(self, segment: int) -> np.ndarray:
        """The hashes of the segment's windows."""
        a, n = int(self.begin[segment]), int(self.length[segment])
        own, at = Grams(self.hashes[a : a + n - 1 + self.window]), np.arange(n)
        return own(at, at + self.window)

    def removed(self, whole: list[int], found: dict[int, np.ndarray]) -> np.ndarray:
        """Which words are covered: by all windows of the segments equal to ``whole``, by those at some places of the segments equal to ``found``."""
        step = np.zeros(len(self.hashes) + 1, np.int64)
        for k in np.flatnonzero(np.isin(self.same, np.array([*whole, *found], np.int64))).tolist():
            begin = self.begin[k] + found.get(int(self.same[k]), np.arange(self.length[k]))
            np.add.at(step, begin, 1)
            np.add.at(step, begin + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _texts(batches):
    """(a piece of a batch, its words, the hashes of the words of each text)."""
    lexer = Lexer(SPACE, lower=False)
    for part in pieces(batches):
        words = lexer(part.column("text"))
        yield part, words, [words.hashes[a:b] for a, b in zip(words.docs[:-1], words.docs[1:], strict=True)]


def _joined(words, row: int, keep: np.ndarray | None = None) -> str:
    """The sha256 of a row's words, or of those kept, joined by a space."""
    digest, data = hashlib.sha256(), words.data
    a, b = int(words.docs[row]), int(words.docs[row + 1])
    places = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
    for x in range(0, len(places), SPAN):
        begin, end = words.starts[places[x : x + SPAN]], words.ends[places[x : x + SPAN]]
        low = begin[0]
        piece = data[low : end[-1]].copy()
        piece[end[:-1] - low] = 0x20
        # each word and the byte after it, which is now a space
        step = np.zeros(len(piece) + 2, np.int8)
        step[begin - low] += 1
        step[end - low + 1] -= 1
        digest.update(b" " * bool(x) + piece[np.cumsum(step[:-2], dtype=np.int8) > 0].tobytes())
    return digest.hexdigest()


_KEY = ["doc_id", "at"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("at"), "text")


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each document, with ``n_words`` and the sha256 of all words, and one for each distinct segment of it: ``anchor, whole, place``."""

    def run(batches):
        for part, words, each in _texts(batches):
            ids, at = part.column("doc_id"), part.column("at")
            held = [Segments(h, window, gram) if i is not None else None for h, i in zip(each, ids.to_pylist(), strict=True)]
            n = pa.array([len(h) for h in each], pa.int64())
            none = pa.nulls(len(each), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, at, n, pa.array([_joined(words, k) for k in range(len(each))]), none, none, none.cast(pa.int32())], names=names)
            first = [np.flatnonzero(s.same == np.arange(len(s.same))) if s else np.empty(0, np.int64) for s in held]
            row = np.repeat(np.arange(len(each)), [len(f) for f in first])
            if len(row):
                column = lambda name: np.concatenate([getattr(s, name)[f] for s, f in zip(held, first, strict=True) if s]).view(np.int64)
                take, nothing = pa.array(row), pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), at.take(take), nothing, nothing.cast(pa.string()), pa.array(column("anchor")), pa.array(column("whole")), pa.array(np.concatenate(first).astype(np.int32))], names=names)

    names = ["doc_id", "at", "n_words", "sha", "anchor", "whole", "place"]
    return _keyed(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, n_words long, sha string, anchor long, whole long, place int")


def lists(segments: DataFrame) -> DataFrame:
    """``doc_id, at, whole, compare``: the places of a document's segments that go whole, and of those to be compared by windows."""
    facts = segments.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("whole") < F.max("whole")).alias("several"))
    common = shared.table(segments.join(facts.filter("low < high").select("anchor", "several"), "anchor"), "substrings-common")
    kinds = common.groupBy("anchor", "whole").agg(F.min("doc_id").alias("low"))
    state = F.when(F.col("doc_id") > F.col("low"), WHOLE).when(F.col("several"), COMPARE)
    found = common.join(kinds, ["anchor", "whole"]).select(*_KEY, "place", state.alias("state")).filter("state is not null").distinct()
    places = lambda s: F.collect_list(F.when(F.col("state") == s, F.col("place")))
    return found.groupBy(*_KEY).agg(places(WHOLE).alias("whole"), places(COMPARE).alias("compare"))


def windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, at, anchor, hash``: the distinct windows of the segments to be compared, however often a text repeats one."""

    def run(batches):
        for part, _, each in _texts(batches):
            ids, at = part.column("doc_id"), part.column("at")
            for k, (h, compare) in enumerate(zip(each, part.column("compare").to_pylist(), strict=True)):
                if not compare:
                    continue
                own = Segments(h, window, gram)
                hashes = [own.windows(s) for s in compare]
                anchor = np.repeat(own.anchor[compare], [len(x) for x in hashes])
                hashes, first = np.unique(np.concatenate(hashes), return_index=True)
                take = pa.array(np.full(len(first), k))
                yield pa.RecordBatch.from_arrays([ids.take(take), at.take(take), pa.array(anchor[first].view(np.int64)), pa.array(hashes.view(np.int64))], names=["doc_id", "at", "anchor", "hash"])

    return texts.filter(F.size("compare") > 0).select(*_KEY, "text", "compare").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, at long, anchor long, hash long")


def cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, at, n_removed, kept_sha256`` of texts with the places ``whole``, and ``found``: hashes of windows that go from those in ``compare``."""

    def run(batches):
        for part, words, each in _texts(batches):
            rows = []
            lists = (part.column(c).to_pylist() for c in ("whole", "compare", "found"))
            for k, (h, whole, compare, found) in enumerate(zip(each, *lists, strict=True)):
                own, known = Segments(h, window, gram), np.array(found or [], np.int64).view(np.uint64)
                some = {s: np.flatnonzero(np.isin(own.windows(s), known)) for s in compare} if found else {}
                gone = own.removed(whole, some)
                rows.append((int(gone.sum()), _joined(words, k, ~gone)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at"), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows])], names=["doc_id", "at", "n_removed", "kept_sha256"])

    return texts.select(*_KEY, "text", "whole", "compare", "found").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, at long, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    seen = shared.table(scanned(docs, window, gram), "substrings-segments")
    places = lists(seen.filter("anchor is not null").select(*_KEY, "anchor", "whole", "place"))
    # of rows with equal id and text one is enough
    texts = shared.table(_keyed(docs.filter("doc_id is not null")).join(places, _KEY).dropDuplicates(_KEY), "substrings-texts")
    made = shared.table(windows(texts, window, gram), "substrings-windows")
    least = made.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor", "hash", "low")
    found = made.join(least, ["anchor", "hash"]).filter("doc_id > low").groupBy(*_KEY).agg(F.collect_list("hash").alias("found"))
    gone = cut(texts.join(found, _KEY, "left").filter(F.col("found").isNotNull() | (F.size("whole") > 0)), window, gram)
    every = seen.filter("anchor is null").select(*_KEY, "n_words", "sha")
    return every.join(gone, _KEY, "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS low FROM wins GROUP BY k),
gone AS (SELECT rid, i FROM wins JOIN least USING (k) WHERE doc_id > low),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT rid, i, word, max(g.i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN gone g USING (rid, i)),
sums AS (SELECT rid, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (rid)
"""
