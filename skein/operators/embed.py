"""Embedding of texts: any object with ``dimensions`` and ``embed(texts)``; one is built in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import prefixed


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words and word pairs hashed into signed counts, of unit length; an empty text is the zero vector."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            words = t.split()
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_texts(df: DataFrame, text: str, embedder: Embedder, model: str = "nomic", batch: int = 64) -> DataFrame:
    """``df`` with ``embedding``. Batches hold texts of like length; a batch that doesn't fit in memory is halved."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = batch
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            at = 0
            while at < len(order):
                take = order[at : at + size]
                try:
                    for i, v in zip(take, embedder.embed([texts[i] for i in take])):
                        out[i] = v.astype(np.float32)
                except MemoryError:
                    if size == 1:
                        raise
                    size = max(1, size // 2)
                    continue
                at += len(take)
            yield pd.Series(out)

    return df.withColumn("embedding", vectors(prefixed(F.coalesce(F.col(text), F.lit("")), model)))
