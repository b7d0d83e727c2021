"""Embedding providers as Arrow functions, and reuse of cached vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .scalars import cache_key


class EmbeddingProvider(Protocol):
    """What turns texts into vectors: its name, the vectors' size, and the call. It is built once in each task."""

    model_id: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingProvider:
    """A provider without a model: signed character trigrams, unit length. For tests and for runs without a network."""

    dimension: int = 64
    model_id: str = "hashing-trigrams"

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for k in range(max(len(t) - 2, 1)):
                h = zlib.crc32(t[k : k + 3].lower().encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed(rows: DataFrame, text: str, make: Callable[[], EmbeddingProvider], *, prefix: str = "", unit: bool = True) -> DataFrame:
    """`rows` plus vector (array<float>), text by text; a vector of another size or one that is not finite is an error. `prefix` goes before queries only."""
    plain = rows.drop("vector")
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        provider = None
        for b in batches:
            provider = provider or make()
            values = np.asarray(provider.embed([prefix + (t or "") for t in b.column(at).to_pylist()]), dtype=np.float32).reshape(b.num_rows, -1)
            if b.num_rows and (values.shape[1] != provider.dimension or not np.isfinite(values).all()):
                raise ValueError(f"{provider.model_id} gave vectors that don't fit")
            if unit:
                size = np.linalg.norm(values, axis=1, keepdims=True)
                values = np.divide(values, size, out=np.zeros_like(values), where=size > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values.tolist(), pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("vector", ArrayType(FloatType()))]))


def embed_cached(rows: DataFrame, text: str, make: Callable[[], EmbeddingProvider], model_id: str, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache entries): each distinct text that the cache (cache_key, vector) lacks is embedded once."""
    keyed = rows.withColumn("cache_key", cache_key(F.lit(model_id), F.coalesce(text, F.lit(""))))
    wanted = keyed.select("cache_key", text).dropDuplicates(["cache_key"])
    if cache is not None:
        wanted = wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    new = embed(wanted, text, make).select("cache_key", "vector")
    both = new if cache is None else cache.select("cache_key", "vector").unionByName(new)
    return keyed.join(both, "cache_key"), new
