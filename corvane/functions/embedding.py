"""Text encoders: a deterministic one that hashes features, and the protocol that a model's encoder meets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corvane.functions.display import prompt
from corvane.functions.scoring import unit

MOST_CHARS = 6000


class Embedder(Protocol):
    """What turns texts into vectors of length 1; a model's encoder is loaded once a worker, in a pandas UDF over iterators."""

    model: str
    dimensions: int

    def encode(self, text: Column, kind: str) -> Column: ...


class HashingEmbedder:
    """Signed counts of hashed words, made length 1: built-in functions only, the same on every run."""

    def __init__(self, dimensions: int = 64):
        self.model, self.dimensions = f"hashing-{dimensions}", dimensions

    def encode(self, text: Column, kind: str = "passage") -> Column:
        words = F.filter(F.split(F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(MOST_CHARS))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(self.dimensions)).alias("at"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
        counts = F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda d: F.aggregate(F.filter(p, lambda x: x["at"] == d), F.lit(0.0), lambda s, x: s + x["sign"])))[0]
        return F.transform(unit(counts), lambda x: x.cast("float"))


_loaded: dict[str, object] = {}


class ModelEmbedder:
    """A model's encoder as an Embedder: load() gives a function from a list of texts to their vectors, once a worker.

    Texts are led by the model's prompt and cut, encoded BATCH at a time, and made length 1; tasks are what runs side by side.
    """

    BATCH = 32

    def __init__(self, model: str, dimensions: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.model, self.dimensions, self.load = model, dimensions, load

    def encode(self, text: Column, kind: str = "passage") -> Column:
        model, load, size = self.model, self.load, self.BATCH

        @pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if model not in _loaded:
                _loaded[model] = load()
            for texts in batches:
                listed = texts.fillna("").tolist()
                found = [np.asarray(_loaded[model](listed[at : at + size]), np.float32) for at in range(0, len(listed), size)]
                found = np.concatenate(found) if found else np.zeros((0, 0), np.float32)
                length = np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(found / length))

        return vectors(prompt(F.coalesce(text, F.lit("")), kind, model, MOST_CHARS))


def build(rows: DataFrame, vectors: DataFrame, key: str, text: str, embedder: Embedder, refresh: bool = False) -> DataFrame:
    """Vectors of rows that this model lacks, with those that it has: the next snapshot."""
    from corvane.operators.tables import pending

    new = pending(rows, vectors, key, F.col(text), embedder.model, refresh).select(key, F.lit(embedder.model).alias("model"), embedder.encode(F.col(text)).alias("vector"))
    old = vectors.join(new.select(key, "model"), [key, "model"], "left_anti")
    return old.select(key, "model", "vector").unionByName(new)
