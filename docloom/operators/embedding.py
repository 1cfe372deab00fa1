"""Vectors from a plug-in model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plugins import PARTS, worked_out

Model = Callable[[list[str]], "list[list[float]]"]


def hashing_model(dim: int = 64) -> Model:
    """A deterministic model for tests: hashed character trigrams, unit length; a shorter text is one gram."""

    def model(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
            c = np.concatenate([c, np.zeros(max(0, 3 - len(c)), np.uint64)])
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + c[2:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
            out[i] = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h & np.uint64(0x10000), 1.0, -1.0), dim)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return model


def embed(df: DataFrame, make_model: Callable[[], Model], col: str = "text_content", out: str = "embedding", batch: int = 100) -> DataFrame:
    """One vector per text, in batches of at most `batch`; a null or blank text is sent as one space. make_model runs once
    for each Python worker's task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for part in parts:
            texts = [t if t and t.strip() else " " for t in part]
            yield pd.Series([v for a in range(0, len(texts), batch) for v in model(texts[a : a + batch])], index=part.index)

    return df.withColumn(out, run(F.col(col)))


def embed_stored(df: DataFrame, make_model: Callable[[], Model], path: str, col: str = "text_content", out: str = "embedding", batch: int = 100, parts: int = PARTS) -> DataFrame:
    """E1 with vectors stored under `path` by the text's hash: of equal texts one is sent, texts that have a vector none, and a run
    that was killed goes on with what is pending. One folder of vectors for each model. Rows as embed() returns them."""
    keyed = df.withColumn("_key", F.sha2(F.coalesce(F.col(col), F.lit("")), 256))
    run = lambda pending: embed(pending, make_model, col, "_vector", batch).select("_key", "_vector")
    vectors = worked_out(keyed.select("_key", col), "_key", run, path, "_key string, _vector array<float>", parts)
    return keyed.drop(out).join(vectors, "_key", "left").withColumnRenamed("_vector", out).select(*(c for c in df.columns if c != out), out)


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """E2 with vectors(document_id, chunk_index, embedding): chunks without one get null."""
    return chunks.drop("embedding").join(vectors.select("document_id", "chunk_index", "embedding"), ["document_id", "chunk_index"], "left")
