"""Embedders. The offline one hashes words into a random projection; real models plug in with the same two methods."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plexora.functions.text import DOCUMENT, QUERY


class Embedder(Protocol):
    """Turns texts into rows of a matrix; must be picklable or build its model on first use in the worker."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Each word of three letters or more is a pseudo-random unit direction told by its hash; a text is their sum at length one."""

    def __init__(self, dim: int = 256):
        self.dim = dim
        self._known: dict[str, np.ndarray] = {}

    def _word(self, w: str) -> np.ndarray:
        v = self._known.get(w)
        if v is None:
            h = 2166136261
            for b in w.encode():
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            v = self._known[w] = np.random.default_rng(h).standard_normal(self.dim)
        return v

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w{3,}", t.lower()):
                out[i] += self._word(w)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed_halving(model: Embedder, texts: list[str]) -> np.ndarray:
    """A batch that doesn't fit in memory is halved until it does."""
    try:
        return model.embed(texts)
    except MemoryError:
        if len(texts) < 2:
            raise
        h = len(texts) // 2
        return np.concatenate([embed_halving(model, texts[:h]), embed_halving(model, texts[h:])])


def embed_column(df: DataFrame, text: str, model: Embedder, out: str = "embedding", batch: int = 256) -> DataFrame:
    """Adds the embedding of a text column, in Arrow batches; null texts get a null embedding."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<float>"

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vecs: list[object] = [None] * len(pdf)
            idx = [i for i, t in enumerate(pdf[text]) if isinstance(t, str)]
            for k in range(0, len(idx), batch):
                part = idx[k : k + batch]
                for i, v in zip(part, embed_halving(model, [pdf[text].iat[i] for i in part])):
                    vecs[i] = v.astype("float32").tolist()
            yield pdf.assign(**{out: vecs})

    return df.mapInPandas(work, schema)


def embed_query(model: Embedder, query: str) -> list[float]:
    """The query side: its own prefix, one vector."""
    return model.embed([QUERY + query])[0].tolist()


def embed_documents(model: Embedder, texts: list[str]) -> list[list[float]]:
    return model.embed([DOCUMENT + t for t in texts]).tolist()
