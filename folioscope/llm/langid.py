"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text accepts every substring of it. A text is
cut greedily into the longest phrases that the automaton accepts; a byte it doesn't know
is a phrase of its own. The fewer phrases per byte, times the bits that name a place in
the training text, the closer the language; the least such entropy wins, ties going to
the smaller name. The score is the winner's margin, 1 - least / second least entropy.

Texts are lower-cased and runs of ASCII characters that aren't letters become one space.
They are parsed whole: in segments of ``SEGMENT`` bytes, ``LOCKSTEP`` of which advance
together, and then on from the state in which the segment before ends until both parses
are in one state, which makes the phrases those of one parse of the whole text. A state holds a bit for each symbol it has an edge for and the place of its
first edge, so an edge is found by counting bits, and the tables are as large as the
automaton is: a few times the training text.

Training: the bounded sample that the classifier is fitted on is, for each language, of
at most ``ROWS`` labelled rows, whole texts, taken in order until they have
``TRAIN_BYTES``: rows of at most ``ROW_BYTES`` by the hash of their id, and only where
these are too few the next longer ones. Prediction reads every whole text.

Edge cases: null, empty and letterless texts are ``und`` with score 0, as is everything
if no row is labelled; an empty table gives no rows; with one language the score is 1;
null ids count as held out or not by the hash of the empty text; equal rows get equal
answers, ties of languages go to the smaller name; a very long text is normalised and
parsed in pieces; other columns, whatever their names, pass through ``accepted`` and
aren't read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import buffers, once, slices

ROWS = 128
ROW_BYTES = 4096
TRAIN_BYTES = 40_000
SEGMENT = 1024
LOCKSTEP = 4096
SLICE = 4 << 20
PIECE = 1 << 20
#: Bits a byte beyond which a text isn't of the language nearest to it: its phrases are hardly longer than two bytes. Doesn't hold for texts that are one phrase of it.
MOST_ENTROPY = 7.0
SCHEMA = "doc_id long, lang_pred string, score double, entropy double"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower case, each run of other ASCII characters one space; made piece by piece."""
    data, offsets = buffers(pc.utf8_lower(texts))
    out, sizes, before = [], np.zeros(len(offsets) - 1, np.int64), False
    for a in range(0, len(data), PIECE):
        piece = data[a : a + PIECE]
        letter = _LETTER[piece]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of others the first, if a letter stands before it
        keep[0] |= before
        before = bool(letter[-1])
        out.append(np.where(letter, piece, np.uint8(32))[keep])
        # what is kept in each row that has a part here
        rows = slice(int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(piece), "left")))
        cuts = np.clip(offsets[rows.start : rows.stop + 1] - a, 0, len(piece))
        sums = np.concatenate([[0], np.cumsum(keep)])
        sizes[rows] += np.diff(sums[cuts])
    return np.concatenate(out) if out else np.empty(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The edges of each state; state 0 is the start, and every path spells a substring."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in edges[at]:
            edges[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = edges[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                twin = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[new] = twin
                while at >= 0 and edges[at].get(symbol) == target:
                    edges[at][symbol] = twin
                    at = link[at]
        last = new
    return edges


class Automaton:
    """A suffix automaton packed for lookups by many states at once; ``symbol`` numbers bytes, 0 for those in no sample."""

    def __init__(self, text: bytes, symbol: np.ndarray, symbols: int):
        edges = suffix_automaton(text)
        self.wide = -(-symbols // 64)
        self.bits = np.zeros(len(edges) * self.wide, np.uint64)
        self.first = np.zeros(len(edges) * self.wide, np.int32)
        to: list[int] = []
        for state, out in enumerate(edges):
            own = sorted((int(symbol[byte]), nxt) for byte, nxt in out.items())
            for w in range(self.wide):
                at = state * self.wide + w
                self.first[at] = len(to)
                mine = [(s & 63, nxt) for s, nxt in own if s >> 6 == w]
                self.bits[at] = sum(1 << s for s, _ in mine)
                to += [nxt for _, nxt in mine]
        self.to = np.array([*to, 0], np.int32)
        # from the start: the state of each symbol, 0 if the text hasn't it
        start, every = np.zeros(symbols, np.int32), np.arange(symbols, dtype=np.uint16)
        to, none = self.step(start, every, np.uint64(1) << (every & 63).astype(np.uint64))
        self.begin = np.where(none, 0, to)

    def step(self, states: np.ndarray, symbols: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the next state of each, which have no edge and so none); ``bit``: that of the symbol."""
        at = states * self.wide + (symbols >> 6) if self.wide > 1 else states
        bits = self.bits[at]
        return self.to[self.first[at] + np.bitwise_count(bits & (bit - np.uint64(1)))], (bits & bit) == 0


class CrossParser:
    def __init__(self, samples: dict[str, bytes], segment: int = SEGMENT):
        self.langs, self.segment = sorted(samples), segment
        seen = sorted(set().union(*map(set, samples.values()))) if samples else []
        self.symbol = np.zeros(256, np.uint16)  # 0: a byte in no sample
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.bit = np.uint64(1) << (np.arange(len(seen) + 1, dtype=np.uint64) & np.uint64(63))
        self.automata = [Automaton(samples[x], self.symbol, len(seen) + 1) for x in self.langs]
        self.samples = samples
        self.cost = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row (first axis) in each language."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // self.segment)
        row = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][row] + nth * self.segment
        length = np.minimum(self.segment, offsets[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        total, last = np.zeros((len(self.langs), len(row)), np.int64), np.zeros((len(self.langs), len(row)), np.int32)
        for a in range(0, len(order), LOCKSTEP):
            some = order[a : a + LOCKSTEP]
            total[:, some], last[:, some] = self.lockstep(data, start[some], length[some])
        out = np.zeros((len(sizes), len(self.langs)))
        for k, own in enumerate(self.automata):
            more = self.joined(own, data, start, length, row, last[k])
            out[:, k] = np.bincount(row, total[k] + more, minlength=len(sizes))
        return out

    def lockstep(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of segments, the longest first, and the states in which they end, by language."""
        width = int(length[0]) if len(length) else 0
        places = np.minimum(start[None, :] + np.arange(width, dtype=np.int32)[:, None], max(0, len(data) - 1))
        grid = self.symbol[data[places]] if width else np.zeros((0, 0), np.uint16)
        live = np.searchsorted(-length, -np.arange(width), "left")  # segments longer than each step
        out, at = np.zeros((len(self.langs), len(start)), np.int32), np.zeros((len(self.langs), len(start)), np.int32)
        for step in range(width):
            n = live[step]
            symbols = grid[step, :n]
            bit = self.bit[symbols]
            for total, states, own in zip(out, at, self.automata, strict=True):
                now = states[:n]
                to, ends = own.step(now, symbols, bit)
                # a phrase begins at the start, and where the one before has no edge; a byte that the text hasn't is one alone
                total[:n] += ends | (now == 0)
                states[:n] = np.where(ends, own.begin[symbols], to)
        return out, at

    def joined(self, own: Automaton, data: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What each segment has more phrases (or fewer) when it goes on from where the one before it in its row ends."""
        more, after = np.zeros(len(row), np.int64), np.full(len(row), -1, np.int64)
        follows = np.zeros(len(row) + 1, bool)
        follows[1 : len(row)] = row[1:] == row[:-1]
        lanes = np.flatnonzero(follows)
        more[lanes], after[lanes] = self.carried(own, data, start[lanes], length[lanes], last[lanes - 1])
        # segments in which the parses don't meet end in another state than was thought; each row is walked on from these
        apart = np.flatnonzero(after >= 0)
        walk = apart[np.unique(row[apart], return_index=True)[1]]
        known: dict[tuple[int, bytes], tuple[int, int]] = {}  # text that repeats itself is parsed once
        while len(walk):
            nxt = (walk + 1)[follows[walk + 1]]
            keys = [(int(after[x - 1]), data[start[x] : start[x] + length[x]].tobytes()) for x in nxt]
            new = list({key: x for key, x in zip(keys, nxt, strict=True) if key not in known}.items())
            if new:
                at = np.array([x for _, x in new])
                known.update(zip((key for key, _ in new), zip(*map(np.ndarray.tolist, self.carried(own, data, start[at], length[at], after[at - 1])), strict=True), strict=True))
            for key, x in zip(keys, nxt, strict=True):
                more[x], after[x] = known[key]
            # those that met go on at the next segment of their row that was apart
            later = np.append(apart, -1)[np.searchsorted(apart, nxt, "right")]
            jump = np.where(after[nxt] >= 0, nxt, later)
            walk = jump[(jump >= 0) & (row[jump] == row[nxt])]
        return more

    def carried(self, own: Automaton, data: np.ndarray, start: np.ndarray, length: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of segments from the states ``came`` less those from the start, and the state at the end, -1 where both parses have met."""
        differ, end = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        lane, old, new, step = np.arange(len(start)), np.zeros(len(start), np.int32), came.astype(np.int32), 0
        while len(lane):
            symbols = self.symbol[data[start[lane] + step]]
            bit, begins = self.bit[symbols], []
            for states in (old, new):
                to, ends = own.step(states, symbols, bit)
                begins.append(ends | (states == 0))
                states[:] = np.where(ends, own.begin[symbols], to)
            differ[lane] += begins[1].astype(np.int64) - begins[0]
            step += 1
            apart, over = old != new, length[lane] == step
            end[lane[apart & over]] = new[apart & over]
            keep = apart & ~over
            lane, old, new = lane[keep], old[keep], new[keep]
        return differ, end

    def __call__(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(language, score, entropy) of each text"""
        n = len(texts)
        has_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs or not n:
            return ["und"] * n, np.zeros(n), np.full(n, np.nan)
        data, offsets = normalised(texts)
        sizes = np.maximum(1, np.diff(offsets))
        entropy = self.phrases(data, offsets) * self.cost / sizes[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        second = np.partition(entropy, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(n, np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(second > 0, np.clip(1 - least / second, 0, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0), np.where(has_letter, least, np.nan)

    def single(self, texts: pa.Array, langs: list) -> np.ndarray:
        """Which texts, normalised, are one phrase of their language?"""
        data, offsets = normalised(texts)
        out = np.zeros(len(texts), bool)
        for k, lang in enumerate(langs):
            own = data[offsets[k] : offsets[k + 1]].tobytes()
            out[k] = lang in self.samples and own in self.samples[lang]
        return out


def samples(labelled: DataFrame, rows: int = ROWS, row_bytes: int = ROW_BYTES, size: int = TRAIN_BYTES) -> dict[str, bytes]:
    """The training text of each language, whole texts, from a frame with ``doc_id, text, lang``."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    work = known.select("lang", F.greatest(F.octet_length("text"), F.lit(row_bytes)).alias("long"), F.xxhash64(F.col("doc_id").cast("string")).alias("at"), "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "at", "text"))
    out: dict[str, bytes] = {}
    for r in work.withColumn("nth", nth).filter(F.col("nth") <= rows).orderBy("lang", "nth").toLocalIterator():
        own = out.get(r["lang"], b"")
        if len(own) < size:
            data, _ = normalised(pa.array([r["text"] + " "]))
            out[r["lang"]] = own + data.tobytes()
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, trained: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, entropy`` of every row. Every worker builds its tables from the bounded samples."""
    held, key = docs.sparkSession.sparkContext.broadcast(trained), uuid.uuid4().hex

    def run(batches):
        parser = once(key, lambda: CrossParser(held.value))
        for part in slices(batches, limit=SLICE):
            langs, score, entropy = parser(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), from_pandas=True)], names=["doc_id", "lang_pred", "score", "entropy"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, trained: dict[str, bytes], most: float = MOST_ENTROPY) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language: not ``und``, and at most ``most`` bits a byte or one phrase."""
    held, key = docs.sparkSession.sparkContext.broadcast(trained), uuid.uuid4().hex

    def run(batches):
        parser = once(key, lambda: CrossParser(held.value))
        for part in slices(batches, limit=SLICE):
            langs, _, entropy = parser(part.column("text"))
            keep = np.array([x != "und" for x in langs], bool)
            costly = np.flatnonzero(keep & ~(entropy <= most))
            keep[costly] = parser.single(part.column("text").take(pa.array(costly)), [langs[k] for k in costly])
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int):
    """Is the row in fold 0 by the crc32 of its id?"""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == 0


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, samples(docs.filter(~held_out(5))))
    return found.select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
