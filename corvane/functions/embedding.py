"""Deterministic hashed embeddings of texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSION = 384


def string_hash(token: str) -> int:
    """The 32-bit string hash h = 31 h + c of a string without characters beyond the basic plane."""
    h = 0
    for c in token:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A unit vector from the hashes of a text's code points and their neighbours; null and empty give zeros.

    A token is a code point's number, or two joined by a colon; it adds one,
    with the sign of its hash's last bit, at its hash modulo the dimension.
    """
    seen: dict[str, tuple[int, float]] = {}

    def place(token: str) -> tuple[int, float]:
        if token not in seen:
            h = string_hash(token)
            seen[token] = (h % DIMENSION, -1.0 if h & 1 else 1.0)
        return seen[token]

    for batch in texts:
        out = []
        for text in batch:
            points = [ord(c) for c in _spaces((text or "").lower())]
            vector = np.zeros(DIMENSION, np.float32)
            for token in [*map(str, points), *(f"{a}:{b}" for a, b in zip(points, points[1:], strict=False))]:
                at, sign = place(token)
                vector[at] += sign
            norm = np.float32(np.sqrt(float((vector.astype(float) ** 2).sum())))
            out.append(vector / norm if norm else vector)
        yield pd.Series(out)


def _spaces(text: str) -> str:
    """Runs of ASCII white space as one space."""
    import re

    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text)
