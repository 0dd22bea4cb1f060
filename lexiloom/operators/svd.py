"""Truncated SVD of a sparse matrix given as rows (target_id, idx, val).

Rows stay distributed: each pass turns batches of rows into partial sums, which Spark adds up by
column. Products with the rows go by blocks of columns of at most BLOCK numbers, so what a task
holds or gets by broadcast is bounded. The driver holds matrices of the columns: columns x rank
for the randomized method, columns x columns for the exact one. A frequency band has at most
1 / lower_bound contexts, so the first is bounded by the options; MAX_DENSE and MAX_GRAM say what
a driver of a few gigabytes holds, and more is an error, never another method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GRAM = 8_000
MAX_DENSE = 100_000_000
#: Numbers in a block of columns, and in all the partial sums of a pass (tasks x columns x block) that go through a shuffle.
BLOCK, PARTIALS = 16_000_000, 1_000_000_000
MAX_TASKS = 256
#: Relative change of the singular values at which power iterations stop, and their greatest number.
SETTLED, MAX_ITERS = 1e-5, 50
#: Singular values below this share of the greatest are dropped.
DROP = 1e-8


@dataclass
class Svd:
    """u: (target_id, vec) for each row; s: falling singular values; v: columns x rank."""

    u: DataFrame
    s: np.ndarray
    v: np.ndarray


def dense(batch: pd.DataFrame, n_cols: int) -> np.ndarray:
    x = np.zeros((len(batch), n_cols))
    rows = np.repeat(np.arange(len(batch)), [len(i) for i in batch["idx"]])
    if len(rows):
        x[rows, np.concatenate(batch["idx"].to_numpy())] = np.concatenate(batch["val"].to_numpy())
    return x


def times(batch: pd.DataFrame, right: np.ndarray) -> np.ndarray:
    """The batch's sparse rows times a dense matrix."""
    out = np.zeros((len(batch), right.shape[1]))
    counts = np.array([len(i) for i in batch["idx"]])
    full = counts.nonzero()[0]
    if len(full):
        cols, vals = np.concatenate(batch["idx"].to_numpy()[full]), np.concatenate(batch["val"].to_numpy()[full])
        ends = counts.cumsum()
        for lo in range(0, len(full), 256):
            some = full[lo : lo + 256]
            a, b = ends[some[0]] - counts[some[0]], ends[some[-1]]
            heads = ends[some] - counts[some] - a
            out[some] = np.add.reduceat(right[cols[a:b]] * vals[a:b, None], heads, axis=0)
    return out


def transposed_product(batch: pd.DataFrame, right: np.ndarray, out: np.ndarray) -> None:
    """Adds the transpose of the batch's sparse rows times a dense matrix to out; work is bounded by entries, not by columns."""
    counts = np.array([len(i) for i in batch["idx"]])
    if not counts.sum():
        return
    cols, vals = np.concatenate(batch["idx"].to_numpy()), np.concatenate(batch["val"].to_numpy())
    rows = np.repeat(np.arange(len(batch)), counts)
    order = np.argsort(cols, kind="stable")
    step = max(1, (1 << 22) // right.shape[1])
    for lo in range(0, len(order), step):
        some = order[lo : lo + step]
        c = cols[some]
        heads = np.concatenate([[0], (c[1:] != c[:-1]).nonzero()[0] + 1])
        out[c[heads]] += np.add.reduceat(right[rows[some]] * vals[some, None], heads, axis=0)


def added(partials: DataFrame) -> DataFrame:
    """(k, vec): the sums of partial rows (k, vec); they are added before the shuffle too."""
    sums = partials.select("k", array_to_vector("vec").alias("vec")).groupBy("k").agg(Summarizer.sum(F.col("vec")).alias("vec"))
    return sums.select("k", vector_to_array("vec").alias("vec"))


def gathered(sums: DataFrame, n: int, width: int) -> np.ndarray:
    """A matrix from its rows (k, vec): n rows of width numbers at most."""
    out = np.zeros((n, width))
    for row in sums.toLocalIterator():
        out[row.k] = row.vec
    return out


def dense_product(batch: pd.DataFrame, right: np.ndarray, out: np.ndarray) -> None:
    """The same as transposed_product, faster where rows are dense and right is wide."""
    out += dense(batch, len(out)).T @ right


def transposed_times(rows: DataFrame, n_cols: int, width: int, right: Callable[[pd.DataFrame], np.ndarray], product=transposed_product) -> DataFrame:
    """(k, vec): A' times the matrix of width columns that right(batch) gives for a batch's rows.

    As few tasks as keep the partial sums within PARTIALS numbers: each makes a matrix of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for lo in range(0, len(batch), 512):
                some = batch.iloc[lo : lo + 512]
                total = np.zeros((n_cols, width)) if total is None else total
                product(some, right(some), total)
        if total is not None:
            for lo in range(0, n_cols, 256):
                block = total[lo : lo + 256]
                yield pd.DataFrame({"k": np.arange(lo, lo + len(block)), "vec": list(block)})

    tasks = max(8, min(MAX_TASKS, PARTIALS // max(1, n_cols * width)))
    return added(rows.coalesce(tasks).mapInPandas(run, "k int, vec array<double>"))


def blocks_of(n_cols: int, width: int) -> list[tuple[int, int]]:
    """First and last of blocks of columns of a dense matrix, BLOCK numbers at most in each."""
    step = max(1, BLOCK // max(1, n_cols))
    return [(lo, min(width, lo + step)) for lo in range(0, width, step)]


def gram_rows(rows: DataFrame, n_cols: int) -> DataFrame:
    """(k, vec): the rows of A'A, whatever the number of columns: in blocks of its columns, joined by row."""
    found = None
    for lo, hi in blocks_of(n_cols, n_cols):
        part = transposed_times(rows, n_cols, hi - lo, lambda b, lo=lo, hi=hi: dense(b, n_cols)[:, lo:hi], dense_product)
        found = part if found is None else found.join(part.withColumnRenamed("vec", "more"), "k").select("k", F.concat("vec", "more").alias("vec"))
    return found


def gram(rows: DataFrame, n_cols: int) -> np.ndarray:
    if n_cols > MAX_GRAM:
        raise ValueError(f"the driver holds a Gram matrix of {MAX_GRAM} columns at most, not of {n_cols}; take the randomized method")
    return gathered(gram_rows(rows, n_cols), n_cols, n_cols)


def normal_times(rows: DataFrame, n_cols: int, q: np.ndarray) -> np.ndarray:
    """A'A times a dense matrix, block by block of its columns."""
    out = []
    for lo, hi in blocks_of(n_cols, q.shape[1]):
        shipped = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(q[:, lo:hi]))  # BLOCK numbers at most
        out.append(gathered(transposed_times(rows, n_cols, hi - lo, lambda b, s=shipped: times(b, s.value)), n_cols, hi - lo))
        shipped.unpersist()
    return np.concatenate(out, axis=1)


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose entry of greatest magnitude is positive."""
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def project(rows: DataFrame, right: np.ndarray) -> DataFrame:
    """(target_id, vec): the rows times a dense matrix, whose blocks of columns are broadcast one by one to each task."""
    if right.size > MAX_DENSE:
        raise ValueError("the dense factor is too large")
    shipped = [rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(right[:, lo:hi])) for lo, hi in blocks_of(*right.shape)]
    empty = np.zeros((0, right.shape[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.concatenate([times(batch, s.value) for s in shipped], axis=1) if shipped else np.zeros((len(batch), empty.shape[1]))
            yield pd.DataFrame({"target_id": batch["target_id"], "vec": list(found)})

    return rows.select("target_id", "idx", "val").mapInPandas(run, "target_id int, vec array<double>")


def _finish(rows: DataFrame, s: np.ndarray, v: np.ndarray) -> Svd:
    keep = s > DROP * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    s, v = s[keep], _signed(v[:, keep]) if keep.any() else v[:, keep]
    return Svd(project(rows, v / s), s, v)


def gaussian_rows(ids: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Standard normal numbers for each row id: the same ones in any partition."""
    return np.stack([np.random.default_rng((seed, int(i))).normal(size=width) for i in ids]) if len(ids) else np.zeros((0, width))


def truncated_svd(
    rows: DataFrame, n_rows: int, n_cols: int, rank: int | None = None, method: str = "randomized", oversample: int = 10, power_iters: int | None = None, seed: int = 0
) -> Svd:
    """The leading rank singular triplets of the uncentred matrix; without a rank, all of them.

    "randomized" projects on a Gaussian sample of the row space and refines it by power iterations
    until the singular values settle (SETTLED), or by a given number of them (oversample=0,
    power_iters=0 is the plain method); "gram" is exact, for as many columns as the driver holds a
    square of. The method is the caller's choice at every size. Each V column's entry of greatest
    magnitude is positive.
    """
    rank = min(n_rows, n_cols) if rank is None else rank
    if not 1 <= rank <= min(n_rows, n_cols):
        raise ValueError(f"rank must be from 1 to {min(n_rows, n_cols)}")
    if method == "gram":
        values, vectors = np.linalg.eigh(gram(rows, n_cols))
        return _finish(rows, np.sqrt(np.maximum(values[::-1][:rank], 0)), vectors[:, ::-1][:, :rank])
    if method != "randomized":
        raise ValueError(f"unknown method {method}")
    r = min(rank + oversample, n_rows, n_cols)
    if n_cols * r > MAX_DENSE:
        raise ValueError(f"the driver holds {MAX_DENSE} numbers of columns x rank at most; take a lower rank or fewer contexts")
    q = np.concatenate([
        gathered(transposed_times(rows, n_cols, hi - lo, lambda b, lo=lo, hi=hi: gaussian_rows(b["target_id"].to_numpy(), r, seed)[:, lo:hi]), n_cols, hi - lo)
        for lo, hi in blocks_of(n_cols, r)
    ], axis=1)
    q, _ = np.linalg.qr(q)
    before = None
    for done in range(MAX_ITERS if power_iters is None else power_iters + 1):
        y = normal_times(rows, n_cols, q)
        small = q.T @ y  # (AQ)'AQ
        values, w = np.linalg.eigh((small + small.T) / 2)
        s = np.sqrt(np.maximum(values[::-1][:rank], 0))
        if done == power_iters or (power_iters is None and before is not None and np.abs(s - before).max() <= SETTLED * s[0]):
            break
        before, (q, _) = s, np.linalg.qr(y)
    return _finish(rows, s, q @ w[:, ::-1][:, :rank])


def symmetric_eigen(rows: DataFrame, n: int, rank: int | None = None, **options) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of a symmetric matrix, from the range that its leading triplets span."""
    q = truncated_svd(rows, n, n, rank, **options).v
    small = q.T @ gathered(transposed_times(rows, n, q.shape[1], lambda b: q[b["target_id"].to_numpy()]), n, q.shape[1])  # Q'AQ, A being its own transpose
    values, w = np.linalg.eigh((small + small.T) / 2)
    return values, q @ w


def principal_components(rows: DataFrame, n_rows: int, n_cols: int, rank: int | None = None, **options) -> tuple[DataFrame, np.ndarray]:
    """Scores U S, as (target_id, vec), and components V; columns aren't centred."""
    svd = truncated_svd(rows, n_rows, n_cols, rank, **options)
    return project(rows, svd.v), svd.v


def inner_products(vectors: DataFrame, width: int) -> DataFrame:
    """(k, vec): the products of the columns of (target_id, vec), width of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack(batch["vec"].to_numpy()) if len(batch) else np.zeros((0, width))
            total += x.T @ x
        yield pd.DataFrame({"k": np.arange(width), "vec": list(total)})

    return added(vectors.select("vec").mapInPandas(run, "k int, vec array<double>"))
