"""Embedding with a model that is passed in, and a deterministic one for tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyze import Analyser

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Each term adds 1 or -1 at a place that its hash tells; vectors have unit length."""
    analyser = Analyser()

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for term in analyser.terms(text):
                h = zlib.crc32(term.encode())
                row[h % dim] += 1 if h >> 16 & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embedded(text: Column, embedder: Embedder, batch: int = 256) -> Column:
    """The vector of each text; null where the text is null."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            for i, v in zip(part, embedder([texts.iloc[i] for i in part])):
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    return vectors(text)
