"""Text and image embedders: a deterministic offline default and a plug-in interface."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from tomegrid.model import IMAGE_DIM

_TOKEN = re.compile(r"[^\W_]+")


class TextEmbedder(Protocol):
    """What a plugged-in model has to offer; ``encode`` gives one vector per text."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Feature hashing: a token adds its sign to a bucket, both from its md5; L2-normalised; empty text is the zero vector."""

    name = "hashing"

    def __init__(self, dim: int = 64, prefix: str = ""):
        self.dim, self.prefix = dim, prefix
        self._slots: dict[str, tuple[int, int]] = {}

    def _slot(self, token: str) -> tuple[int, int]:
        got = self._slots.get(token)
        if got is None:
            if len(self._slots) > 1_000_000:
                self._slots.clear()
            h = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
            got = self._slots[token] = (int(h[:7], 16) % self.dim, 1 if int(h[7], 16) % 2 == 0 else -1)
        return got

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            slots = [self._slot(w) for w in _TOKEN.findall((self.prefix + t).lower())]
            if slots:
                at, sign = zip(*slots)
                np.add.at(out[i], list(at), list(sign))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def sentence_transformer(name: str, dim: int):
    """Adapter to a locally installed model; the library is imported on the worker, once."""

    class Adapter:
        def __init__(self):
            from sentence_transformers import SentenceTransformer

            self.name, self.dim, self._model = name, dim, SentenceTransformer(name)

        def encode(self, texts: list[str]) -> np.ndarray:
            return self._model.encode(texts, normalize_embeddings=True)

    return Adapter


def embed_text(column: Column, make=HashingEmbedder) -> Column:
    """Vectors of a text column; ``make()`` runs once per worker, null text counts as empty."""

    @pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model.encode(s.fillna("").tolist())), index=s.index)

    return encode(column)


def embed_image(column: Column, encode_bytes=None, dim: int = IMAGE_DIM) -> Column:
    """Vectors of a binary column; unreadable or null images give the zero vector. The default hashes bytes to a unit vector."""

    def default(data: bytes) -> np.ndarray:
        v = np.random.default_rng(int.from_bytes(hashlib.md5(data, usedforsecurity=False).digest()[:8], "big")).standard_normal(dim)
        return v / np.linalg.norm(v)

    run = encode_bytes or default

    @pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        def one(data):
            try:
                return np.asarray(run(bytes(data)), dtype=np.float32)
            except Exception:  # an unreadable image counts as none
                return np.zeros(dim, dtype=np.float32)

        return s.map(one, na_action=None)

    return encode(column)
