"""Word vectors from a decomposition, and vectors of new words by folding in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.vectors import scale_each, truncate, unit
from lexiloom.operators.svd import Svd, project


def weights(s: np.ndarray, eig: float, strict: bool = True) -> np.ndarray:
    """Singular values to the power eig, for the powers 0, 0.5 and 1; strict=False takes any other for 1."""
    if not 0 <= eig <= 1:
        raise ValueError("eig must be from 0 to 1")
    if eig == 0:
        return np.ones_like(s)
    if eig == 0.5:
        return np.sqrt(s)
    if eig != 1 and strict:
        raise ValueError("eig must be 0, 0.5 or 1")
    return s


def scale(vectors: DataFrame, by: np.ndarray, dim: int, normalize: bool = False, col: str = "vec") -> DataFrame:
    """The first dim components, each times its weight, optionally over the vector's length."""
    if not 1 <= dim <= len(by):
        raise ValueError(f"dim must be from 1 to {len(by)}")
    v = scale_each(truncate(F.col(col), dim), F.array(*[F.lit(float(x)) for x in by[:dim]]))
    return vectors.withColumn(col, unit(v) if normalize else v)


def embeddings(svd: Svd, dim: int, eig: float = 0.0, normalize: bool = False, strict: bool = True) -> DataFrame:
    """(target_id, vec): U S^eig, truncated."""
    return scale(svd.u, weights(svd.s, eig, strict), dim, normalize)


def fold_in(rows: DataFrame, svd: Svd, dim: int, eig: float = 0.0, normalize: bool = False, strict: bool = True) -> DataFrame:
    """(target_id, vec) of new rows over the same contexts: A V / S^(1 - eig). A V is scaled once, before the pass over the rows."""
    if not 1 <= dim <= len(svd.s):
        raise ValueError(f"dim must be from 1 to {len(svd.s)}")
    found = project(rows, svd.v[:, :dim] / weights(svd.s, 1 - eig, strict)[:dim])
    return found.withColumn("vec", unit(F.col("vec"))) if normalize else found


def named(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word_id, word, vec) of words (word_id, word) and vectors (target_id, vec), which must have the same ids."""
    check_aligned(words, vectors)
    return words.select("word_id", "word").join(vectors.withColumnRenamed("target_id", "word_id"), "word_id")


def check_aligned(words: DataFrame, vectors: DataFrame, key: str = "target_id", word_key: str = "word_id") -> None:
    """Words and vectors must have the same ids."""
    left, right = words.select(F.col(word_key).alias("k")), vectors.select(F.col(key).alias("k"))
    if not left.join(right, "k", "left_anti").isEmpty() or not right.join(left, "k", "left_anti").isEmpty():
        raise ValueError("words and vectors don't have the same ids")
