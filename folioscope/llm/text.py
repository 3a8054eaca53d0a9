"""Words of Arrow string batches as 64-bit hashes, without a Python object per word.

A lexer is given the bytes that separate words; all other bytes (so all of UTF-8 beyond
ASCII) belong to words. The hash of a word is a polynomial in random 64-bit values of its
bytes, taken as a difference of prefix sums and then mixed, so that one vectorised pass
over a batch hashes every word in it. Bytes are read in blocks of ``BLOCK``, across which
words go on, so that beyond the words found only a block's temporaries are held, however
long a text or a word is. With 64 bits two of n distinct words share a hash with a
probability of about n*n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the contracts, and what is neither an ASCII letter or digit nor beyond ASCII.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BLOCK = 1 << 18
SLICE_BYTES = 1 << 20

_BASE = 0xA24BAED4963EE407 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(*hashes: np.ndarray) -> np.ndarray:
    """The hash of sequences, given the hashes of their members."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of one slice: ``docs[i]:docs[i + 1]`` are those of row i; byte positions are into ``data``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    lower: bool

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def bytes_of(self, k: int) -> bytes:
        out = self.data[self.starts[k] : self.ends[k]].tobytes()
        return out.lower() if self.lower else out  # bytes.lower changes A-Z only


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Lexer:
    def __init__(self, separators: bytes = SPACE, lower: bool = True):
        self.lower = lower
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.value = np.random.default_rng(20_240_601).integers(1, 1 << 64, 256, np.uint64)
        if lower:
            self.inside[65:91] = self.inside[97:123]
            self.value[65:91] = self.value[97:123]
        self.value[~self.inside] = 0

    def __call__(self, texts: pa.Array) -> Words:
        data, offsets = buffers(texts)
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        starts, ends, hashes, opened, part = [], [], [], -1, 0
        forward, back = _powers(_BASE), _powers(_BACK)
        for a in range(0, len(data), BLOCK):
            piece = data[a : a + BLOCK]
            n = len(piece)
            word = self.inside[piece]
            # a word ends where the next byte is none, or another text's
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            here = cut[np.searchsorted(cut, a) : np.searchsorted(cut, a + n, "right")] - a
            first[here[here < n]] = word[here[here < n]]
            last[here[here > 0] - 1] = word[here[here > 0] - 1]
            goes_on = a + n < len(data) and not (len(here) and here[-1] == n) and bool(word[-1]) and bool(self.inside[data[a + n]])
            if goes_on:
                last[-1] = False
            if opened >= 0:
                first[0] = False
            begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[piece] * forward[:n], out=sums[1:])
            stop = end
            if opened >= 0:  # the word from before ends here or goes on
                to = end[0] if len(end) else n
                part += int(sums[to]) * pow(_BASE, a - opened, 1 << 64)
                if len(end):
                    hashes.append(np.array([part % (1 << 64)], np.uint64))
                    opened, stop = -1, end[1:]
            whole = begin[: len(stop)]
            hashes.append((sums[stop] - sums[whole]) * back[whole])
            if goes_on and opened < 0:
                opened = a + int(begin[-1])
                part = int(((sums[n:] - sums[begin[-1:]]) * back[begin[-1:]])[0])
            starts.append((begin + a).astype(kind))
            ends.append((end + a).astype(kind))
        starts, ends, hashes = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((starts, kind), (ends, kind), (hashes, np.uint64)))
        return Words(mix(hashes), starts, ends, np.searchsorted(starts, offsets), data, offsets, self.lower)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cuts record batches at rows so that each piece holds about ``limit`` bytes of ``column``, one row at least; trims memory at the end."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, a = np.cumsum(sizes, dtype=np.int64), 0
        while a < batch.num_rows:
            before = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(a, b - a)
            a = b
        del batch, sizes, total
    trim()


_MADE: dict = {}


def once(key, make):
    """What ``make`` returns, made once in a worker's life for a key; only the last key's is kept."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def pieces(batches, column: str = "text", limit: int = SLICE_BYTES):
    """``slices`` for a task that keeps nothing between tasks: what an earlier stage kept in this worker goes first.

    """
    _MADE.clear()
    yield from slices(batches, column, limit)


def trim() -> None:
    """Gives freed memory back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


class Memo:
    """Values of words by their hash, kept by a worker from batch to batch; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.keys, self.places, self.n = limit, np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is new."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1)

    def full(self, more: int) -> bool:
        return len(self.keys) + more > self.limit

    def clear(self) -> None:
        self.__init__(self.limit)

    def add(self, hashes: np.ndarray) -> None:
        """Gives new distinct hashes, in order, the next places."""
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.places = np.insert(self.places, at, np.arange(self.n, self.n + len(hashes)))
        self.n += len(hashes)


class Stack:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.empty(1 << 12, dtype), 0

    def push(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            more = np.empty(max(2 * len(self.held), self.n + len(values)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)
