"""Vectors of texts: the embedder's interface and an offline one from hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An empty text is embedded as this.
NO_TEXT = "[NO_TEXT]"
BATCH = 96


class Embedder(Protocol):
    """A vector for each text, in order. Called in tasks on batches; it must be picklable."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Counts of character 3- and 4-grams of lower-case words, hashed to ``dims`` signed cells, at unit length."""

    def __init__(self, dims: int = 128):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            padded = f" {' '.join((text or NO_TEXT).lower().split())} "
            for n in (3, 4):
                for i in range(max(len(padded) - n + 1, 1)):
                    h = zlib.crc32(padded[i : i + n].encode("utf-8"))
                    row[h % self.dims] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def embed_texts(texts: DataFrame, keys: list[str], embedder: Embedder | None = None, batch: int = BATCH) -> DataFrame:
    """(keys..., vector) of ``texts(keys..., text)``: each distinct text is embedded once."""
    model = embedder or HashedNgrams()
    distinct = texts.select(F.coalesce("text", F.lit("")).alias("text")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                own = frame["text"].iloc[i : i + batch].tolist()
                vectors = np.asarray(model.encode([t or NO_TEXT for t in own]), dtype=float)
                if len(vectors) != len(own):
                    raise ValueError(f"{len(vectors)} vectors for {len(own)} texts")
                yield pd.DataFrame({"text": own, "vector": list(vectors)})

    found = distinct.mapInPandas(run, "text string, vector array<double>")
    return texts.withColumn("text", F.coalesce("text", F.lit(""))).join(found, "text").select(*keys, "vector")
