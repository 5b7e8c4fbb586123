"""Models as functions of columns. A model is any picklable callable over a list of strings; stand-ins here are deterministic."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("positive", "negative", "na")


def scalar_model(model: Callable[[list[str]], list[str]], batch: int = 32, tries: int = 3) -> Callable[[Column], Column]:
    """A text model as a column function, called in batches; a batch that fails is tried again, then gives nulls."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list = []
            for i in range(0, len(s), batch):
                part = [x or "" for x in s.iloc[i : i + batch]]
                for attempt in range(tries):
                    try:
                        out += model(part)
                        break
                    except RuntimeError:
                        if attempt == tries - 1:
                            out += [None] * len(part)
            yield pd.Series(out, index=s.index)

    return run


def embedding_model(model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list = []
            for i in range(0, len(s), batch):
                out += model([x or "" for x in s.iloc[i : i + batch]])
            yield pd.Series(out, index=s.index)

    return run


def stub_classifier(texts: list[str]) -> list[str]:
    """A label that the text's hash gives."""
    return [LABELS[hashlib.md5(t.encode()).digest()[0] % 3] for t in texts]


def stub_embedding(texts: list[str], dim: int = 16) -> list[list[float]]:
    """Counts of hashed words, of unit length."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            v[hashlib.md5(w.encode()).digest()[0] % dim] += 1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out
