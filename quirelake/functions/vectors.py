"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Encoder = Callable[[Sequence[str]], np.ndarray]


def literal(vector: Sequence[float]) -> Column:
    """A vector as a constant column."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product, of as many components as the shorter has; null where one is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    both = F.least(F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), total(a, b)).when(a.isNotNull() & b.isNotNull(), total(F.slice(a, 1, both), F.slice(b, 1, both)))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_score(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity on a scale from 0 to 1."""
    return (1 + dot(a, b) / (norm(a) * norm(b))) / 2


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a text model: hashed words and their character
    trigrams, with unit length."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                for piece in [word, *(f"#{word}#"[k : k + 3] for k in range(len(word)))]:
                    h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode_udf(make: Callable[[], Encoder], batch: int = 32):
    """A pandas UDF that encodes texts; ``make`` is called once for each worker's
    iterator, as a model would be loaded."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            found = [v for i in range(0, len(texts), batch) for v in encode(texts.iloc[i : i + batch].tolist())]
            yield pd.Series(found)

    return run


def encode_query(encoder: Encoder, text: str) -> list[float]:
    """A query's vector; blank text is an error."""
    if not text.strip():
        raise ValueError("query is blank")
    return [float(x) for x in encoder([text])[0]]


def percentile(values: Sequence[float], p: float) -> float:
    """The value at place min(n - 1, floor(n p)) of the sorted ones."""
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, math.floor(len(ordered) * p))]
