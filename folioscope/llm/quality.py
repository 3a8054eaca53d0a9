"""Quality rules: compression bands.

Each whole text, and each of its chunks of ``CHUNK`` bytes, is compressed with zstandard;
the ratio of compressed to plain bytes says how repetitive (low) or how incompressible
(high) it is. Ratios fall with length, so the limits are per band of length. A text goes
if its own ratio is outside its band, or if more than ``CHUNK_SHARE`` of its chunks are
outside the band of a chunk. Base rules on words and repeated three-word windows come
first.

The query fits its bands: of the labelled rows of quality 1 the ``SAMPLE`` of least hash of
their id that pass the base rules give median ratios by half octave of length, and the
ratios by these medians have quantiles ``TAILS``, beyond which a text falls out. The sample
bounds only the fit; every row is judged. Lengths with fewer than ``LEAST`` rows of the
sample at either end have the general limits ``BANDS``.

Edge cases: a null text is like an empty one: no words, base_failed, not kept. The last
chunk counts in the band of its own length. Texts shorter than the first band's start
are never judged by ratio. Equal rows are judged alike; in the fit a repeated id counts
once and a null id never; tables without rows or without labels give no rows or the
general limits; a very long text is compressed whole and costs arrays of its words;
other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, Lexer, joined, mix, pieces

CHUNK = 4096
LEVEL = 3
CHUNK_SHARE = 0.5
#: From so many bytes on: the least and the most that compressed / plain bytes may be.
BANDS = ((200, 0.30, 0.90), (500, 0.25, 0.80), (1000, 0.22, 0.72), (4000, 0.20, 0.68), (16000, 0.18, 0.65))
SAMPLE = 4000
LEAST = 10
TAILS = (0.005, 0.999)
#: Bands of a fit in an octave of length.
STEPS = 16
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def _per_row(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions are in each row."""
    return np.diff(np.searchsorted(positions, offsets))


def outside(plain: int, packed: int, bands=BANDS) -> bool:
    """Is the ratio outside the band of that length?"""
    at = bisect_right(bands, plain, key=lambda b: b[0])
    return at > 0 and not bands[at - 1][1] <= packed / plain <= bands[at - 1][2]


class Rules:
    def __init__(self, chunk: int = CHUNK, level: int = LEVEL, share: float = CHUNK_SHARE, bands=BANDS):
        import zstandard

        self.words, self.lines = Lexer(SPACE, lower=False), Lexer(b"\n", lower=False)
        self.symbol = np.zeros(256, bool)
        self.symbol[list(b"#*$%&|<>")] = True
        self.chunk, self.share, self.bands, self.packer = chunk, share, bands, zstandard.ZstdCompressor(level=level)

    def compression(self, text: np.ndarray) -> tuple[float | None, float]:
        """(ratio of the whole, share of chunks outside their band)"""
        if not len(text):
            return None, 0.0
        view = memoryview(text)
        whole = len(self.packer.compress(view))
        if len(view) <= self.chunk:
            return whole / len(view), float(outside(len(view), whole, self.bands))
        bad = n = 0
        for a in range(0, len(view), self.chunk):
            piece = view[a : a + self.chunk]
            bad += outside(len(piece), len(self.packer.compress(piece)), self.bands)
            n += 1
        return whole / len(view), bad / n

    def __call__(self, part: pa.RecordBatch) -> pa.RecordBatch:
        words, lines = self.words(part.column("text")), self.lines(part.column("text"))
        data, offsets = words.data, words.offsets
        n_words = words.counts
        blank = np.flatnonzero(~self.words.inside[data])
        points = np.flatnonzero((data & 0xC0) == 0x80)  # of a code point all bytes but the first
        word_chars = np.diff(offsets) - _per_row(points, offsets) - _per_row(blank, offsets)
        symbols = _per_row(np.flatnonzero(self.symbol[data]), offsets)
        # lines with a word, by text and row
        worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
        row = lines.rows[worded]
        _, first = np.unique(joined(row.astype(np.uint64), lines.hashes[worded]), return_index=True)
        dup_lines = np.bincount(row, minlength=len(n_words)) - np.bincount(row[first], minlength=len(n_words))
        repeat = self.repeated(words)
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        packed = [self.compression(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        good = np.array([r is not None and not outside(b - a, round(r * (b - a)), self.bands) and s <= self.share for (r, s), a, b in zip(packed, offsets[:-1], offsets[1:], strict=True)], bool)
        return pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id"), "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
            "base_failed": failed, "kept": ~failed & good, "ratio": pa.array([r for r, _ in packed], pa.float64()), "bad_chunks": pa.array([s for _, s in packed], pa.float64()),
        })

    @staticmethod
    def repeated(words) -> np.ndarray:
        """Words of each row inside a three-word window that the row has twice or more."""
        h, row = words.hashes, words.rows
        hit = np.zeros(len(h) + 1, bool)
        if len(h) >= 3:
            inner = np.flatnonzero(row[2:] == row[:-2])
            keys = joined(h[inner], h[inner + 1], h[inner + 2]) ^ mix(row[inner].astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inner[twice]
            hit[at] = hit[at + 1] = hit[at + 2] = True
        return _per_row(np.flatnonzero(hit[:-1]), words.docs)


def rules(docs: DataFrame, **limits) -> DataFrame:
    """The statistics and verdict of every row of ``docs`` (``doc_id, text``)."""

    def run(batches):
        own = Rules(**limits)
        for part in pieces(batches):
            yield own(part)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def bands_of(measured: list[tuple[int, float]], tails=TAILS, least: int = LEAST) -> tuple:
    """Bands from (bytes, ratio) of ordinary texts, ``BANDS`` at lengths that these don't cover."""
    first = BANDS[0][0]
    sizes, ratios = np.array([(n, r) for n, r in measured if n >= first], float).reshape(-1, 2).T
    half = np.floor(2 * np.log2(sizes / first)).astype(int)
    used = [k for k in np.unique(half).tolist() if (half == k).sum() >= least]
    if not used:
        return BANDS
    x = [np.median(np.log2(sizes[half == k])) for k in used]
    y = [np.median(ratios[half == k]) for k in used]
    start, end = first * 2 ** (used[0] / 2), first * 2 ** ((used[-1] + 1) / 2)
    inside = (sizes >= start) & (sizes < end)
    low, high = np.quantile(ratios[inside] / np.interp(np.log2(sizes[inside]), x, y), tails)
    steps = np.arange(np.log2(start), np.log2(end) - 1e-9, 1 / STEPS)
    middle = np.interp(steps + 0.5 / STEPS, x, y)
    fit = [(int(np.ceil(2**s)), float(low * m), float(high * m)) for s, m in zip(steps, middle, strict=True)]
    # longer texts compress better: the last upper limit holds on, the lower one falls back
    general = [b for b in BANDS if b[0] < fit[0][0]]
    after = int(np.ceil(end))
    at = bisect_right(BANDS, after, key=lambda b: b[0]) - 1
    tail = [(max(b, after), lo, min(hi, fit[-1][2])) for b, lo, hi in BANDS[at:]]
    return (*general, *fit, *tail)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """Bands from the labelled rows (``doc_id, quality``) of quality 1."""
    wanted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        own = Rules(bands=())
        for part in pieces(batches):
            found = own(part)
            out = pa.table({"doc_id": found.column("doc_id"), "plain": pc.binary_length(part.column("text").cast(pa.binary())).cast(pa.int64()), "ratio": found.column("ratio")})
            yield from out.filter(pc.invert(found.column("base_failed"))).to_batches()

    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, plain long, ratio double")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("plain", "ratio")).alias("m"))  # repeated ids count once
    return bands_of([(r.m.plain, r.m.ratio) for r in rows.collect()])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rules(docs, bands=fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
