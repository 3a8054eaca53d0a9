"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting: tasks turn texts into word hashes, sort and count them in large batches, and
send each part of the model one block of sorted (key, count) arrays per batch; a part
merges its blocks. Where there are more than ``FAN`` parts, blocks go to groups of parts
first and are merged and cut finer from level to level, so a batch never makes more than
``FAN`` blocks and their number grows with the corpus alone. Words are numbered by the
order of their hashes, so a word's number is its place in the sorted hash arrays, and a
bigram is the 64-bit key (left number << 32 | right number). Bigrams are dealt to parts by
a hash of the key, so a frequent left word is spread over all parts; what a part knows of
its contexts and of its right words is counted once more in the same way, by ranges of
word numbers, of which there are as many as there are parts to read.

The model is a folder in the shared store: sorted arrays of word hashes, of bigram keys
with their counts (a byte each, larger ones in an array of their own), and by word number
the token counts, the numbers of distinct left neighbours, and the context's total and its
numbers of bigrams seen once, twice and more often. Workers memory-map these files when
they first need them and look up the sorted distinct keys of a span of tokens, so what
they hold in memory is one span, whatever the size of the model or of a text.

Probabilities: P(w | v) = (c(v w) - D) / c(v) + g(v) P(w), with P(w) from the continuation
counts in the same way over the uniform 1 / (V + 1), which also is what unknown words
get; D is the modified discount for counts 1, 2 and 3 or more, of each order. A text starts from a
boundary context and its end is scored as a word.

Edge cases: null and empty texts are the end alone; without training rows every
probability is 1 / (V + 1) = 1; counts of counts that leave a discount undefined use 0.5,
1 and 1.5; an empty table gives no rows; equal rows score alike and count as often as they
are there; very long texts are scored span by span; null ids count as held out or not by
the hash of the empty text; other columns, whatever their names, aren't read. More than
2**32 - 1 distinct words are an error, as keys hold 32 bits of a number.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .langid import held_out
from .text import Lexer, mix, once, slices, trim

END = np.uint64(0x9D8A3C5E71B24F06)  # the hash of the end of a text
GATHER = 2_000_000  # tokens that are sorted and counted together
PART_TOKENS = 4_000_000  # tokens per part of the model
FAN = 1024  # blocks that a batch makes at most
RANGE = 1 << 12, 1 << 18  # word numbers per file of word statistics, at the least and the most
SPAN = 1 << 18  # tokens that are scored together
MANY = 255  # counts from here on are in an array of their own
KINDS = 5  # statistics of a word that bigrams tell
FALLBACK = (0.5, 1.0, 1.5)


def with_ends(words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, each closed by the end; where each text stops)"""
    hashes = np.insert(words.hashes, words.docs[1:], END)
    return hashes, words.docs[1:] + np.arange(1, len(words.docs))


def tallied(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return keys[first], sums.astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed."""
    import zstandard

    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, dtype) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def small(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts, np.int64))


def large(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


BLOCKS = "part int, salt int, keys binary, counts binary"


def coarse(parts: int, fan: int) -> int:
    """How many parts are taken together at first, so that there are at most ``fan`` groups."""
    step = 1
    while -(-parts // step) > fan:
        step *= fan
    return step


def _blocks(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray, salt: int) -> pa.RecordBatch:
    """A row per owner of sorted distinct keys."""
    order = np.argsort(owner, kind="stable")
    keys, counts, owner = keys[order], counts[order], owner[order]
    rows = [(p, salt, packed(keys[a:b]), small(counts[a:b])) for p, a, b in _runs(owner)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "salt", "keys", "counts"])


def _runs(values: np.ndarray):
    """(value, start, end) of each run of sorted values."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return zip(values[cuts].tolist(), cuts.tolist(), np.append(cuts, len(values))[1:].tolist(), strict=True)


def _salt(n: int) -> int:
    """A number for the nth batch of this task that spreads the blocks of a group."""
    return (TaskContext.get().partitionId() * 7919 + n) % (1 << 20)


def settled(blocks: DataFrame, parts: int, owner, gather: int, fan: int) -> DataFrame:
    """The blocks that were dealt to ``owner(keys) // coarse``, cut finer until each is one part's, dealt and sorted by part."""
    step = coarse(parts, fan)
    while step > 1:
        finer = step // fan

        def refined(batches, finer=finer):
            n = 0
            for _, some in _by_part(batches, gather):
                keys, counts = _merged(some)
                yield _blocks(keys, counts, owner(keys) // finer, _salt(n))
                n += 1

        spread = blocks.repartition(parts, F.col("part"), F.pmod("salt", F.lit(step))).sortWithinPartitions("part")
        blocks, step = spread.mapInArrow(refined, BLOCKS), finer
    return blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part")  # a part a task; by hash some would get several


def _gathered(arrays, limit: int = GATHER):
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += len(x)
        if n >= limit:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _by_part(batches, limit: int | None = None):
    """(part, blocks) for each part of a partition that is sorted by part; in several pieces of about ``limit`` bytes if one is given."""
    part, held, size = None, [], 0
    for b in batches:
        for p, keys, counts in zip(b.column("part").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
            if held and (p != part or (limit and size >= limit)):
                yield part, held
                held, size = [], 0
            part = p
            held.append((keys.as_buffer(), counts.as_buffer()))
            size += len(keys.as_buffer())
    if held:
        yield part, held


def _merged(blocks) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a part as one, merged in pairs so that no more than twice the result is held."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for keys, counts in blocks:
        now = unpacked(keys, np.uint64), large(counts)
        while done and len(done[-1][0]) <= 2 * len(now[0]):
            old = done.pop()
            now = tallied(np.concatenate([old[0], now[0]]), np.concatenate([old[1], now[1]]))
        done.append(now)
    while len(done) > 1:
        a, b = done.pop(), done.pop()
        done.append(tallied(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))
    return done[0]


def _file(folder: str, name: str, values: np.ndarray) -> None:
    shared.put(f"{folder}/{name}", lambda out: out.write(np.ascontiguousarray(values)))


class Vocabulary:
    """Numbers of words, from the memory-mapped sorted hash arrays of all parts."""

    def __init__(self, files: shared.Files, sizes: list[int]):
        self.files, self.sizes = files, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n = int(self.base[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each of some sorted hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for p, a, b in _runs(part_of_hash(hashes, len(self.sizes))):
            if self.sizes[p]:
                own = self.files(f"words-{p:06d}.u64", np.uint64)
                at = np.minimum(np.searchsorted(own, hashes[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == hashes[a:b], at + self.base[p], -1)
        return out


def part_of_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash, in order; the top 32 bits decide."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def part_of_key(keys: np.ndarray, n: int) -> np.ndarray:
    return part_of_hash(mix(keys + np.uint64(0x51ED270B)), n)


def left_of(numbers: np.ndarray, stops: np.ndarray, start: int) -> np.ndarray:
    """The left word of each token; ``start`` is the boundary context."""
    left = np.concatenate([[start], numbers[:-1]])
    left[stops[:-1]] = start
    return left


def discounts(counts) -> tuple[float, float, float]:
    """Modified discounts from the numbers of entries counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if min(n1, n2, n3) <= 0:
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    out = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d < k + 1 else f for k, (d, f) in enumerate(zip(out, FALLBACK, strict=True)))


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


class Model:
    """A trained model's files; ``meta`` is what the driver knows of it: a few numbers and the sizes of its parts."""

    def __init__(self, folder: str, meta: dict):
        self.__dict__.update(meta)
        self.files = shared.Files(folder)
        self.vocabulary = Vocabulary(self.files, self.sizes)
        self.n = self.vocabulary.n

    def word(self, numbers: np.ndarray) -> np.ndarray:
        """Six statistics of each word number (a row each): tokens, context total, once, twice, more often, left neighbours."""
        out = np.zeros((1 + KINDS, len(numbers)), np.int64)
        owner = np.where(numbers >= 0, numbers // self.range, -1)
        for r in np.unique(owner[owner >= 0]).tolist():
            at = np.flatnonzero(owner == r)
            out[:, at] = self.files(f"stats-{r:06d}.i64", np.int64).reshape(1 + KINDS, -1)[:, numbers[at] - r * self.range]
        return out

    def bigram(self, keys: np.ndarray) -> np.ndarray:
        """Counts of some keys."""
        out, owner = np.zeros(len(keys), np.int64), part_of_key(keys, len(self.bigrams))
        order = np.argsort(owner, kind="stable")
        for p, a, b in _runs(owner[order]):
            if self.bigrams[p]:
                own, at = self.files(f"bigrams-{p:06d}.u64", np.uint64), order[a:b]
                place = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
                out[at] = np.where(own[place] == keys[at], counts_at(self.files, p, place), 0)
        return out

    def score(self, before: np.uint64, hashes: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: count in training, base log10 probability, the model's log10 probability.

        ``before`` is the token before the first one, and ``opens`` says which ones begin a text.
        """
        words, back = np.unique(np.concatenate([[before], hashes]), return_inverse=True)
        number = self.vocabulary.numbers(words)
        tokens, total, once_, twice, more, lefts = self.word(number)
        uniform = 1 / (self.n + 1)
        if self.types:
            d = np.array([0.0, *self.d1])
            gone = d[1] * self.c1[0] + d[2] * self.c1[1] + d[3] * (self.entries - self.c1[0] - self.c1[1])
            p1 = (lefts - d[np.minimum(lefts, 3)]) / self.types + gone / self.types * uniform
        else:
            p1 = np.full(len(words), uniform)
        d = np.array([0.0, *self.d2])
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(total > 0, (d[1] * once_ + d[2] * twice + d[3] * more) / total, 1.0)
        s_total, s_gamma = self.start_total, (d[1] * self.start[0] + d[2] * self.start[1] + d[3] * self.start[2]) / self.start_total if self.start_total else 1.0
        # the context of each token: a place among the words, or the boundary
        context, back = np.where(opens, len(words), back[:-1]), back[1:]
        number, gamma, total = np.append(number, self.n), np.append(gamma, s_gamma), np.append(total, s_total)
        left, right = number[context], number[back]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        keys, inverse = np.unique((left[both].astype(np.uint64) << np.uint64(32)) | right[both].astype(np.uint64), return_inverse=True)
        seen = np.zeros(len(hashes))
        c = self.bigram(keys)
        seen[both] = (c - d[np.minimum(c, 3)])[inverse]
        p = np.where(total[context] > 0, seen / np.maximum(total[context], 1), 0.0) + gamma[context] * p1[back]
        base = np.log10((tokens + 0.1) / (self.tokens + 0.1 * (self.n + 1)))
        return tokens[back], base[back], np.log10(p)


def write_counts(folder: str, part: int, counts: np.ndarray) -> None:
    """A byte a count; from ``MANY`` on that says that place and count are in the file beside it."""
    many = np.flatnonzero(counts >= MANY)
    _file(folder, f"counts-{part:06d}.u8", np.minimum(counts, MANY).astype(np.uint8))
    _file(folder, f"many-{part:06d}.i64", np.concatenate([many, counts[many]]).astype(np.int64))


def counts_at(files: shared.Files, part: int, places: np.ndarray) -> np.ndarray:
    out = files(f"counts-{part:06d}.u8", np.uint8)[places].astype(np.int64)
    many = np.flatnonzero(out == MANY)
    if len(many):
        where, counts = files(f"many-{part:06d}.i64", np.int64).reshape(2, -1)
        out[many] = counts[np.searchsorted(where, places[many])]
    return out


def train(docs: DataFrame, gather: int = GATHER, part_tokens: int = PART_TOKENS, fan: int = FAN, least: int = RANGE[0]) -> tuple[str, dict]:
    """Counts ``docs`` and writes the model; returns its folder and what ``Model`` needs to read it."""
    spark = docs.sparkSession
    folder = shared.folder(spark, "kneser-ney")
    # a few characters make a token; the parts only have to be of about that size
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / 6 / part_tokens))
    step = coarse(parts, fan)
    texts = docs.select("text")

    def counted(keys, owner, step: int):
        for n, some in enumerate(_gathered(keys, gather)):
            some, counts = tallied(some)
            yield _blocks(some, counts, owner(some) // step, _salt(n))

    def word_part(keys):
        return part_of_hash(keys, parts)

    def word_blocks(batches):
        lexer = Lexer()
        yield from counted((with_ends(lexer(x.column("text")))[0] for x in slices(batches)), word_part, step)

    def word_parts(batches):
        for part, blocks in _by_part(batches):
            keys, counts = _merged(blocks)
            _file(folder, f"words-{part:06d}.u64", keys)
            _file(folder, f"tokens-{part:06d}.i64", counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})
        trim()

    words = settled(texts.mapInArrow(word_blocks, BLOCKS), parts, word_part, gather * 4, fan)
    found = shared.table(words.mapInArrow(word_parts, "part int, n long, total long"), "word-parts").collect()  # a row per part
    sizes = [0] * parts
    for r in found:
        sizes[r["part"]] = r["n"]
    types, tokens = sum(sizes), sum(r["total"] for r in found)
    if types >= 1 << 32:
        raise ValueError(f"{types} distinct words are more than a key can number")
    if not types:
        return folder, {"sizes": sizes, "bigrams": sizes, "range": 1, "tokens": 0, "types": 0, "entries": 0, "c1": [0] * 4, "d1": FALLBACK, "d2": FALLBACK, "start": [0] * 3, "start_total": 0}
    width = min(max(least, math.ceil(types / (2 * parts))), RANGE[1])
    ranges = types // width + 1  # number ``types`` is the boundary
    key = uuid.uuid4().hex

    def bigram_part(keys):
        return part_of_key(keys, parts)

    def bigram_blocks(batches):
        lexer, vocabulary = Lexer(), once((key, "words"), lambda: Vocabulary(shared.Files(folder), sizes))

        def keys():
            for x in slices(batches):
                hashes, stops = with_ends(lexer(x.column("text")))
                distinct, back = np.unique(hashes, return_inverse=True)
                right = vocabulary.numbers(distinct)[back]
                yield (left_of(right, stops, types).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

        yield from counted(keys(), bigram_part, step)

    def bigram_parts(batches):
        for part, blocks in _by_part(batches):
            keys, counts = _merged(blocks)
            _file(folder, f"bigrams-{part:06d}.u64", keys)
            write_counts(folder, part, counts)
            of, rights = _of_counts(counts), np.sort((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            left = (keys >> np.uint64(32)).astype(np.uint32)
            n = len(keys)
            del keys
            told = []  # (word, kind) and what this part adds to it
            for kind, (some, weights) in enumerate([(left, counts), (left[counts == 1], None), (left[counts == 2], None), (left[counts > 2], None), (rights, None)]):
                number, sums = sorted_sums(some, weights)
                told.append((number.astype(np.uint64) * np.uint64(KINDS) + np.uint64(kind), sums))
            del left, rights, counts
            numbers, sums = tallied(np.concatenate([x for x, _ in told]), np.concatenate([x for _, x in told]))
            yield row(part, n, of)
            rows = _blocks(numbers, sums, stat_part(numbers) // coarse(ranges, fan), _salt(part))
            for a in range(0, rows.num_rows, 64):
                yield stat_rows(rows.slice(a, 64))
        trim()

    def sorted_sums(numbers, weights):
        """Sums by number, of sorted numbers; without weights their counts."""
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.empty(0, np.int64)
        return numbers[first], np.diff(np.append(first, len(numbers))) if weights is None else np.add.reduceat(weights, first)

    def stat_part(keys):
        return (keys // np.uint64(KINDS * width)).astype(np.int64)

    def row(part, n, of):
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([of], pa.list_(pa.int64()))], names=STATS)

    def stat_rows(blocks):
        k = blocks.num_rows
        return pa.RecordBatch.from_arrays([*blocks.columns, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64()))], names=STATS)

    pairs = settled(texts.mapInArrow(bigram_blocks, BLOCKS), parts, bigram_part, gather * 4, fan)
    stats = shared.table(pairs.mapInArrow(bigram_parts, f"{BLOCKS}, of int, n long, c array<long>"), "bigram-stats")
    bigrams, c2 = [0] * parts, np.zeros(4, np.int64)
    for r in stats.filter("of is not null").select("of", "n", "c").collect():  # a row per part
        bigrams[r["of"]] = r["n"]
        c2 += r["c"]

    def word_stats(batches):
        files = shared.Files(folder)
        for r, blocks in _by_part(batches):
            keys, sums = _merged(blocks)
            out = np.zeros((1 + KINDS, width), np.int64)
            out[0] = _tokens(files, sizes, r * width, width)
            number, kind = np.divmod(keys.astype(np.int64), KINDS)
            out[1 + kind, number - r * width] = sums
            _file(folder, f"stats-{r:06d}.i64", out)
            lefts = out[KINDS][: max(0, min(width, types - r * width))]
            start = out[:, types - r * width] if 0 <= types - r * width < width else np.zeros(1 + KINDS, np.int64)
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "entries": [int((lefts > 0).sum())], "types": [int(lefts.sum())], "c": [_of_counts(lefts)], "start": [start.tolist()]})
        trim()

    spread = settled(stats.filter("part is not null").select("part", "salt", "keys", "counts"), ranges, stat_part, gather * 4, fan)
    done = shared.table(spread.mapInArrow(word_stats, "range int, entries long, types long, c array<long>, start array<long>"), "word-stats").collect()  # a row per range
    shared.drop(stats)
    c1 = np.sum([r["c"] for r in done], axis=0)
    start = np.sum([r["start"] for r in done], axis=0)
    meta = {"sizes": sizes, "bigrams": bigrams, "range": width, "tokens": tokens, "types": sum(r["types"] for r in done), "entries": sum(r["entries"] for r in done)}
    return folder, meta | {"c1": c1.tolist(), "d1": discounts(c1), "d2": discounts(c2), "start": start[2:5].tolist(), "start_total": int(start[1])}


STATS = ["part", "salt", "keys", "counts", "of", "n", "c"]


def _tokens(files: shared.Files, sizes: list[int], low: int, width: int) -> np.ndarray:
    """The token counts of the words of a range, from the files of the parts it meets."""
    out, base = np.zeros(width, np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for p in np.flatnonzero((base[:-1] < low + width) & (base[1:] > low)).tolist():
        a, b = max(base[p], low), min(base[p + 1], low + width)
        out[a - low : b - low] = files(f"tokens-{p:06d}.i64", np.int64)[a - base[p] : b - base[p]]
    return out


def scored(docs: DataFrame, model: tuple[str, dict], span: int = SPAN) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row."""
    folder, meta = model
    held = docs.sparkSession.sparkContext.broadcast(meta)  # a few numbers per part

    def run(batches):
        own, lexer = once((folder, "model"), lambda: Model(folder, held.value)), Lexer()
        for part in slices(batches):
            hashes, stops = with_ends(lexer(part.column("text")))
            first = np.concatenate([[0], stops[:-1]])
            n, opens = stops - first, np.zeros(len(hashes), bool)
            opens[first] = True
            known, base, total = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            for a in range(0, len(hashes), span):
                some = slice(a, min(a + span, len(hashes)))
                count, by_base, by_model = own.score(hashes[max(a - 1, 0)], hashes[some], opens[some])
                row = np.searchsorted(stops, np.arange(some.start, some.stop), "right")
                at, row = row[0], row - row[0]
                for out, values in ((known, count > 0), (base, by_base), (total, by_model)):
                    sums = np.bincount(row, values)
                    out[at : at + len(sums)] += sums.astype(out.dtype)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), own.tokens, np.int64),
                "base_score": base, "score": total, "perplexity": 10.0 ** np.minimum(300, -total / n),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, train(docs.filter(~held_out(10))))
    return out.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
