"""Token counts by a linear longest-match automaton.

The vocabulary is a byte-level one whose pieces either begin a word (they carry the
leading-space mark) or continue it. Two tries over it, one for each kind, become one
automaton: where the trie has no edge, a failure link leads to the node of what is left
after the pieces that greedy longest match would cut off there, and a number precomputed
with the link says how many pieces those are. A word is then counted in one pass over
its bytes, whatever the pieces' lengths, and no piece is ever built.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, case kept. Every byte is a piece, so no
word lacks a match. A worker counts each distinct word of a batch once and keeps counts
from batch to batch (at most ``Memo.limit`` words).

Edge cases: null, empty and blank texts have 0 words and tokens; an empty table gives no
rows; a very long text is lexed in blocks and a very long word is one pass over its bytes;
equal rows are counted alike; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Lexer, Memo, once, slices

SCHEMA = "doc_id long, n_words long, n_tokens long"


def byte_marks() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes; those with special names are left out."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    marks, special = byte_marks(), {x["content"] for x in file.get("added_tokens", [])}
    return [bytes(marks[c] for c in piece) for piece in file["model"]["vocab"] if piece not in special]


class Automaton:
    """Counts pieces of words. ``pieces``: those with a leading space begin a word, those without any continue one."""

    BEGIN, REST = 0, 1

    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}, {}]
        final = {self.BEGIN: b" " in set(pieces)}
        for piece in pieces:
            begins = piece[:1] == b" "
            body, at = piece[begins:], self.BEGIN if begins else self.REST
            if not body or b" " in body:
                continue
            for byte in body:
                nxt = edges[at].get(byte)
                if nxt is None:
                    edges.append({})
                    nxt = edges[at][byte] = len(edges) - 1
                at = nxt
            final[at] = True
        # breadth first: a node's link is known before those of its children
        link, popped = [-1] * len(edges), [0] * len(edges)
        if final[self.BEGIN]:
            link[self.BEGIN], popped[self.BEGIN] = self.REST, 1
        queue = [self.BEGIN, self.REST]
        for parent in queue:
            for byte, node in edges[parent].items():
                queue.append(node)
                if final.get(node):
                    link[node], popped[node] = self.REST, 1
                    continue
                at, n = link[parent], popped[parent]
                while at >= 0 and byte not in edges[at]:
                    n += popped[at]
                    at = link[at]
                if at >= 0:
                    link[node], popped[node] = edges[at][byte], n
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        """The number of pieces of greedy longest match; 0 for an empty word, -1 where none matches."""
        edges, link, popped = self.edges, self.link, self.popped
        at, n = self.BEGIN, 0
        for byte in word:
            nxt = edges[at].get(byte)
            while nxt is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
                nxt = edges[at].get(byte)
            at = nxt
        while word and at != self.REST:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row; ``path``: a byte-level tokenizer file that every machine has."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        automaton, lexer, memo, held = once(("pieces", path), lambda: (Automaton(vocabulary(path)), Lexer(lower=False), Memo(), [np.empty(0, np.int64)]))
        for part in slices(batches):
            words = lexer(part.column("text"))
            distinct, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            if memo.full(len(distinct)):
                memo.clear()
                held[0] = held[0][:0]
            new = np.flatnonzero(memo.find(distinct) < 0)
            memo.add(distinct[new])
            held[0] = np.concatenate([held[0], np.array([automaton.count(words.bytes_of(k)) for k in first[new]], np.int64)])
            tokens = np.concatenate([[0], np.cumsum(held[0][memo.find(distinct)][back])])
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": words.counts, "n_tokens": np.diff(tokens[words.docs])})

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
