"""Outside models behind Arrow-batched columns: encoders, rerankers, language models.

The stand-ins here are deterministic and need nothing installed. What they return says
nothing about the quality of a model in their place.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """Stand-in encoder: counts of words by hash."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                row[zlib.crc32(word.encode()) % self.size] += 1
        return out


class Echo:
    """Stand-in language model: answers with the first source; J7's three ways of asking."""

    name = "echo"

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"See [Source 1]. ({len(p or '')} characters)" for p in prompts]

    def stream(self, prompt: str):
        """The answer in pieces, as they come."""
        for word in self([prompt])[0].split(" "):
            yield word + " "

    def chat(self, messages: list[dict]) -> str:
        """The answer to the last message of a user, after those before it."""
        return self([m["content"] for m in messages if m["role"] == "user"][-1:])[0]


def encoded(text: Column, encoder: Encoder) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(s.tolist())))

    return run(text)


def reranker(settings, made=None):
    """I16: the scorer that the settings ask for, None if they don't; ``made(model name)`` builds an outside one, else the stand-in scores."""
    if not settings.reranker:
        return None
    return overlap() if made is None else made(settings.reranker_model)


def overlap(question: str = "text", content: str = "content"):
    """Stand-in reranker: the share of the question's distinct words that a chunk has."""

    def score(df) -> Column:
        asked, held = F.array_distinct(tokens(F.col(question))), F.array_distinct(tokens(F.col(content)))
        return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)

    return score
