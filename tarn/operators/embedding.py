"""Embedding providers (UDF-1, UDF-2): text to vectors, offline by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 32
BATCH = 16

Provider = Callable[[list[str]], list[list[float]]]
PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often it is used: a lambda's variable is bound, an expression is written out at every use."""
    return F.transform(F.array(value), use)[0]


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic embedding of the words' hashes, of length one (zero for a text without words); no Python."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # A word's slot, doubled, and one more where its sign is negative.
    codes = F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(dimensions)) * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("int"))
    at = lambda c, code: F.size(F.filter(c, lambda x: x == code))
    raw = _once(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: (at(c, d * 2) - at(c, d * 2 + 1)).cast("double")))
    return _once(raw, lambda r: _once(F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)), lambda length: F.transform(r, lambda x: F.when(length == 0, 0.0).otherwise(x / length))))


def embed(rows: DataFrame, key: str, text: str, provider: str | Provider, batch: int = BATCH) -> DataFrame:
    """VEC-10, VEC-11, SRC-25: (key, embedding) by a provider that takes batches; a wrong number or an empty vector is an error."""
    call = PROVIDERS[provider] if isinstance(provider, str) else provider

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = call([t if isinstance(t, str) else "" for t in part["text"]])
                if len(vectors) != len(part) or not all(len(v) for v in vectors):
                    raise ValueError(f"the provider gave {len(vectors)} vectors for {len(part)} texts, or empty ones")
                yield pd.DataFrame({key: part[key], "embedding": vectors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<double>")
