"""A deterministic embedding of texts by hashed words, where no model is at hand."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def hashed(texts: list[str | None], dim: int) -> np.ndarray:
    """Unit vectors: each word adds a fixed signed direction; null and empty texts are zero vectors."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for w in _WORD.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-12), out)


def hashed_column(text: Column, dim: int) -> Column:
    """The same as a column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(hashed(s.tolist(), dim)))

    return run(text)
