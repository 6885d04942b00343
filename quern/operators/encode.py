"""Text encoders as a strategy, resumable embedding by language, and the error of half-precision storage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.files import missing_partitions

#: Makes an encoder (texts -> matrix of unit rows) once in each task; so a model is loaded where it is used.
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 768) -> Callable[[], Encoder]:
    """A deterministic encoder without a model: signed hashed words, of unit length."""

    def make() -> Encoder:
        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if word not in known:
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                known[word] = (h % width, 1.0 if h >> 63 else -1.0)
            return known[word]

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for row, text in enumerate(texts):
                for word in text.lower().split():
                    at, sign = place(word)
                    out[row, at] += sign
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return encode

    return make


def encoded(texts: DataFrame, make: Callable[[], Encoder], prefix: str = "", batch: int = 512) -> DataFrame:
    """Adds v (array<float>) to rows with a text column; blank texts are left out."""
    names = [c for c in texts.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                yield part.assign(v=list(encode([prefix + t for t in part["text"]])))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.where(F.trim("text") != "").select(*names).mapInPandas(run, f"{kinds}, v array<float>")


def resumed(surfaces: DataFrame, make: Callable[[], Encoder], path: str, prefix: str = "") -> None:
    """Encodes the languages of (id, lang, text) that `path` has no folder for yet, one folder each, committed as a whole."""
    todo = missing_partitions(surfaces, surfaces.sparkSession, path)
    encoded(todo, make, prefix).drop("text").write.mode("append").partitionBy("lang").parquet(path)


def half_error(vectors: DataFrame, n: int = 256) -> float:
    """Greatest difference of inner products that storing as half precision makes, on `n` rows chosen by the hash of their id."""
    rows = vectors.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(n).select("v").collect()
    a = np.array([r[0] for r in rows], np.float32)
    h = a.astype(np.float16).astype(np.float32)
    return float(np.abs(a @ a.T - h @ h.T).max(initial=0.0))
