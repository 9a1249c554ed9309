"""Embedders: functions from texts to vectors, as columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.text import hash_embedding


def embedder(function: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A model that embeds a list of texts, as a column function. Texts go to
    Python in Arrow batches; null counts as empty."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in function(texts.fillna("").tolist())], dtype=object)

    return embed


def hashing(dim: int) -> Callable[[Column], Column]:
    """An embedder without a model, for tests and as a stand-in; all built-in."""
    return lambda texts: hash_embedding(texts, dim)


def six_fold(dim: int) -> Callable[[Column], Column]:
    """Each word counts in six buckets, from the MD5 shifted five bits further
    each time, with weights 1, 1/2, ... 1/6; commas and stops part words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in re.split(r"[\s,.]+", text.lower()):
                if word:
                    h = int.from_bytes(hashlib.md5(word.encode()).digest(), "big")
                    np.add.at(v, [(h >> 5 * j) % dim for j in range(6)], [1 / (j + 1) for j in range(6)])
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embedder(embed)


def averaged(vectors: Column, dim: int) -> Column:
    """The mean of several vectors of a text, of dim components."""
    n = F.greatest(F.size(vectors), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.coalesce(F.try_element_at(v, k.cast("int")).cast("double"), F.lit(0.0))) / n)
