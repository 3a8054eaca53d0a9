"""Token-ID output in Arrow's file format, as batches of fixed-size lists.

Documents in ascending id order are encoded, each closed with an end id, and packed into
sequences of equal length. A file holds record batches with two columns, ``ids``
(fixed_size_list of uint16, or of uint32 for vocabularies of more than 65,536) and
``mask`` (fixed_size_list of bool, false where the last sequence of the file is filled
up). As every batch but the last has the same number of
sequences, sequence i of a memory-mapped file is a view found by division. Beside it,
``*.docs.arrow`` has each document's id, start and length within the file.

Range partitions of the id become files named by partition, so the files in name order
hold the corpus in id order. A file appears under its name only when it is whole, and the
list of files is written once as a table; what a lost task left is replaced by its retry.

Words between white space are encoded apart, which the tokenizer's own splitting allows
(white space ends every piece and is dropped), so a worker encodes each distinct word
once and keeps its ids from batch to batch, up to ``MEMO`` words. Words go through in
spans of ``SPAN``, so a very long text costs its ids and no more than a span's work.

Edge cases: null and empty texts are the end id alone; an empty table writes no file and
gives no rows; rows with equal ids follow each other by a hash of the text and then the
text, and may lie in several files; ids may be null (first); a very long text runs on
over batches; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .text import Lexer, Memo, Stack, once, slices

LENGTH = 2048
BATCH = 256
END = 1
MEMO = 1 << 20
SPAN = 1 << 18
MARK = "\x01"
GROUP = 128
CALL = 16
FILES = "part int, path string, docs long, tokens long, sequences long"


class WordEncoder:
    """ids of texts, word by word through a tokenizer whose pieces end at white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END + 1)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.lexer = Lexer(lower=False)
        self.forget()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # one id that no other text has

    def forget(self) -> None:
        """Starts without known words: their ids one after another, and where those of each end."""
        self.memo, self.ids, self.ends = Memo(MEMO), Stack(np.uint32), Stack(np.int64)
        self.ends.push(np.zeros(1, np.int64))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Many words in one call, parted by the mark; words that hold the mark go alone."""
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if self.mark is not None and MARK not in w]
        groups = [plain[a : a + GROUP] for a in range(0, len(plain), GROUP)]
        for at in range(0, len(groups), CALL):  # a call's results hold far more than ids
            some = groups[at : at + CALL]
            for group, coded in zip(some, self.tokenizer.encode_batch_fast([f" {MARK} ".join(words[k] for k in g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) != len(group) - 1:
                    continue
                for k, a, b in zip(group, [0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
                    out[k] = ids[a:b].copy()
        for k, own in enumerate(out):
            if own is None:
                out[k] = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
        return out

    def of_words(self, words, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some words in a row, how many each has)"""
        distinct, first, back = np.unique(words.hashes[some], return_index=True, return_inverse=True)
        if self.memo.full(len(distinct)):
            self.forget()
        place = self.memo.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            coded = self.encode_words([words.bytes_of(some.start + k).decode() for k in first[new].tolist()])
            place[new] = self.memo.n + np.arange(len(new))
            self.memo.add(distinct[new])
            self.ids.push(np.concatenate(coded))
            self.ends.push(self.ends.held[self.ends.n - 1] + np.cumsum([len(x) for x in coded], dtype=np.int64))
        start = self.ends.held[place]
        size = (self.ends.held[place + 1] - start)[back]
        start = start[back]
        stop = np.cumsum(size)
        return self.ids.held[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], size

    def __call__(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), each closed with ``end``."""
        words = self.lexer(texts)
        stops, out, sizes = words.docs[1:], [], np.ones(len(texts), np.int64)
        row = at = 0
        while at < len(words.hashes) or row < len(stops):
            to = min(at + SPAN, len(words.hashes))
            ids, size = self.of_words(words, slice(at, to))
            done = int(np.searchsorted(stops, to, "right"))  # texts that stop in this span
            done = len(stops) if to == len(words.hashes) else done
            cuts = np.concatenate([[0], np.cumsum(size)])[stops[row:done] - at]
            sums = np.diff(np.concatenate([[0], cuts, [len(ids)]]))
            sizes[row:done] += sums[:-1]
            if done < len(sizes):
                sizes[done] += sums[-1]
            out.append(np.insert(ids, cuts, end))
            row, at = done, to
        return np.concatenate(out) if out else np.empty(0, np.uint32), sizes


def fixed(values: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class SequenceWriter:
    """Packs ids into sequences and writes them in batches of ``batch`` sequences."""

    def __init__(self, sink, length: int, batch: int, kind=np.uint32):
        self.length, self.room, self.kind = length, length * batch, kind
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file, self.schema, self.held, self.n, self.tokens, self.sequences = pa.ipc.new_file(sink, schema), schema, [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)
        if self.n >= self.room:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.room * self.room
            for a in range(0, whole, self.room):
                self._write(ids[a : a + self.room], self.room)
            self.held, self.n = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, room: int) -> None:
        mask = np.zeros(room, bool)
        mask[: len(ids)] = True
        ids = ids.astype(self.kind)
        self.file.write_batch(pa.record_batch([fixed(np.pad(ids, (0, room - len(ids))), self.length), fixed(mask, self.length)], schema=self.schema))
        self.sequences += room // self.length

    def close(self) -> None:
        if self.n:
            self._write(np.concatenate(self.held), -(-self.n // self.length) * self.length)
        self.file.close()


class Sequences:
    """Random access to the sequences of a file, as views of its memory map where the store allows one."""

    def __init__(self, uri: str):
        store, path = shared.filesystem(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path))
        self.per = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch = self.file.get_batch(i // self.per)
        return batch.column(0)[i % self.per].values.to_numpy(), batch.column(1)[i % self.per].values

    def flat(self, k: int) -> np.ndarray:
        """The ids of batch k in a row, without a copy."""
        return self.file.get_batch(k).column(0).flatten().to_numpy()

    def reader(self):
        """A function that gives the pieces within batches of a span of the file's ids; spans are asked for in ascending order."""
        k, base, flat = -1, 0, np.empty(0, np.uint32)

        def pieces(start: int, size: int):
            nonlocal k, base, flat
            end = start + size
            while start < end:
                while start >= base + len(flat):
                    base, k = base + len(flat), k + 1
                    flat = self.flat(k)
                piece = flat[start - base : end - base]
                start += len(piece)
                yield piece

        return pieces


def write(docs: DataFrame, folder: str, tokenizer: str, *, length: int = LENGTH, batch: int = BATCH, end: int = END) -> DataFrame:
    """Writes the sequences of ``docs`` and returns the table of files, with the ``offset`` of each in the corpus."""

    def run(batches):
        part = TaskContext.get().partitionId()
        path = f"{folder}/sequences-{part:06d}.arrow"
        encoder = once(("encoder", tokenizer), lambda: WordEncoder(tokenizer))
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        feed, told = chain([head], batches), {}
        del head  # else it would be held to the end

        def body(sink):
            writer, schema = SequenceWriter(sink, length, batch, encoder.kind), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

            def index(out):
                docs = 0
                with pa.ipc.new_file(out, schema) as rows:
                    for piece in slices(feed):
                        ids, sizes = encoder(piece.column("text"), end)
                        starts = writer.tokens + np.cumsum(sizes) - sizes
                        writer.add(ids)
                        docs += len(sizes)
                        rows.write_batch(pa.record_batch([piece.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
                told["docs"] = docs

            shared.put(path.removesuffix(".arrow") + ".docs.arrow", index)
            writer.close()
            told.update(tokens=writer.tokens, sequences=writer.sequences)

        shared.put(path, body)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [told["docs"]], "tokens": [told["tokens"]], "sequences": [told["sequences"]]})

    # an id that many rows share is cut by their texts, and rows that are equal by where they come from
    work = docs.select("doc_id", "text", F.xxhash64("text").alias("at"), F.monotonically_increasing_id().alias("row"))
    ordered = work.repartitionByRange("doc_id", "at", "row").select("doc_id", "text", "at").sortWithinPartitions("doc_id", "at", "text").select("doc_id", "text")
    files = shared.table(ordered.mapInArrow(run, FILES), "sequence-files")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``start`` counts all ids before it. A task a file."""

    def run(batches):
        for rows in batches:
            for path, offset in zip(rows.column("path").to_pylist(), rows.column("offset").to_pylist(), strict=True):
                store, at = shared.filesystem(path.removesuffix(".arrow") + ".docs.arrow")
                pieces = Sequences(path).reader()
                with store.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        yield _digests(pieces, index.get_batch(k), offset)

    def _digests(pieces, spans, offset):
        starts, sizes = (spans.column(c).to_numpy() for c in ("start", "n_tokens"))
        sums = np.empty(len(starts), np.int64)
        for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            crc = 0
            for piece in pieces(start, size):
                crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
            sums[k] = crc
        return pa.RecordBatch.from_arrays([spans.column("doc_id"), pa.array(starts + offset), spans.column("n_tokens"), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "offset").repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` to a new shared folder and reads the digests back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read(write(docs, shared.folder(docs.sparkSession, "sequences"), tokenizer, **options))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
