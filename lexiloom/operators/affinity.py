"""Products of stated queries' rows with all rows of a sparse matrix, block by block.

The queries' rows are shipped to the tasks, and each task has whole rows of the matrix, so a
product is complete where it is made: no pair of rows goes through a shuffle. Rows are multiplied
as dense blocks of the columns that they use; a product is positive if and only if two rows share
a column, as all entries are positive.

With the matrix of cooc.hellinger() a product is the Bhattacharyya affinity of two context distributions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.cooc import csr

#: Entries of queries' rows that are shipped together; more take more passes.
ENTRIES = 1 << 21
#: Rows, queries and columns of a block.
ROWS, QUERIES, COLUMNS = 512, 512, 8192
#: Digits of an affinity that ranks go by.
DIGITS = 9

#: ids of some rows and queries, their squared lengths, and the products (rows x queries).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _entries(found: list) -> tuple[np.ndarray, ...]:
    """(ids, entries of each row, columns, values) of sparse rows (target_id, idx, val)."""
    return np.array([r.target_id for r in found]), np.array([len(r.idx) for r in found]), np.concatenate([r.idx for r in found]).astype(np.int32), np.concatenate([r.val for r in found]).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], queries: tuple[np.ndarray, ...], rows: int, width: int, columns: int) -> Iterator[Block]:
    """The products of the rows of the batches with the queries; the blocks of queries come in the same order for each block of rows."""
    ids, lengths, cols, vals = queries
    at = np.repeat(np.arange(len(ids)), lengths)
    own = np.bincount(at, vals * vals, len(ids))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            some = batch.slice(lo, rows)
            idx, val = some.column(1), some.column(2)
            counts = np.diff(idx.offsets.to_numpy())
            row, col, x = np.repeat(np.arange(len(counts)), counts), idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy()
            names, n2 = some.column(0).to_numpy(), np.bincount(row, x * x, len(counts))
            used, place = np.unique(col, return_inverse=True)
            where = np.full(max(col.max(initial=0), cols.max(initial=0)) + 1, -1)
            where[used] = np.arange(len(used))
            there = where[cols]
            for a in range(0, len(ids), width):
                s, e = np.searchsorted(at, [a, a + width])
                out = np.zeros((len(names), min(width, len(ids) - a)))
                for c in range(0, len(used), columns):
                    left, right = np.zeros((len(names), min(columns, len(used) - c))), np.zeros((min(columns, len(used) - c), out.shape[1]))
                    here, asked = (place >= c) & (place < c + columns), (there[s:e] >= c) & (there[s:e] < c + columns)
                    left[row[here], place[here] - c] = x[here]
                    right[there[s:e][asked] - c, at[s:e][asked] - a] = vals[s:e][asked]
                    out += left @ right
                yield names, n2, ids[a : a + width], own[a : a + width], out


def _mapped(matrix: DataFrame, asked: DataFrame, fn: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], values: str) -> DataFrame:
    """(query_id, target_id, values...) that fn makes of the blocks of each task; matrix, asked: (target_id, ctx_id, a), or rows (target_id, idx, val)."""
    rows, asked = (df if "idx" in df.columns else csr(df) for df in (matrix, asked))
    name = rows.schema["target_id"].dataType.simpleString()
    schema = f"query_id {name}, target_id {name}, {values}"
    sizes = ROWS, QUERIES, COLUMNS
    found, held, n = [], [], 0

    def shipped() -> DataFrame:
        queries = rows.sparkSession.sparkContext.broadcast(_entries(held))
        return rows.mapInArrow(lambda batches: fn(_blocks(batches, queries.value, *sizes)), schema)

    for row in asked.toLocalIterator():
        held.append(row)
        n += len(row.idx)
        if n >= ENTRIES:
            found.append(shipped())
            held, n = [], 0
    if held or not found:
        found.append(shipped() if held else rows.sparkSession.createDataFrame([], schema))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def affinity(matrix: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, target_id, affinity): the products of the rows of asked with all rows of matrix that share a column."""

    def pairs(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for names, _, ids, _, out in blocks:
            i, j = out.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(ids[j].astype(names.dtype)), pa.array(names[i]), pa.array(out[i, j])], ["query_id", "target_id", "affinity"])

    return _mapped(matrix, asked, pairs, "affinity double")


def squared_distances(matrix: DataFrame, asked: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, target_id, d2): squared distances of the rows of asked to all rows of matrix that share a column, 0 at least.

    digits: they are rounded as they are made, halves up.
    """

    def pairs(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for names, n2, ids, own, out in blocks:
            i, j = out.nonzero()
            d2 = np.maximum(own[j] + n2[i] - 2 * out[i, j], 0.0)
            if digits is not None:
                d2 = np.floor(d2 * 10.0**digits + 0.5) / 10.0**digits
            yield pa.RecordBatch.from_arrays([pa.array(ids[j].astype(names.dtype)), pa.array(names[i]), pa.array(d2)], ["query_id", "target_id", "d2"])

    return _mapped(matrix, asked, pairs, "d2 double")


def most_alike(matrix: DataFrame, asked: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, target_id, affinity): for each row of asked the top rows of matrix by affinity, rounded to DIGITS, and by id.

    Each task keeps a query's best of its rows; these few are ranked.
    """
    if top < 1:
        raise ValueError("top must be positive")

    def best(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}  # by the first id of a block of queries: place in the block, key, id, product
        asked_ids: dict[int, np.ndarray] = {}
        for names, _, ids, _, out in blocks:
            key = np.floor(out * 10.0**DIGITS + 0.5)
            last = np.full(len(ids), -1.0)
            old = kept.get(ids[0], [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, names.dtype), np.zeros(0)])
            full, least = np.bincount(old[0], minlength=len(ids)) >= top, np.full(len(ids), np.inf)
            np.minimum.at(least, old[0], old[1])
            last[full] = least[full]
            i, j = ((out > 0) & (key >= last)).nonzero()
            q, k, t, x = (np.concatenate(z) for z in zip(old, (j, key[i, j], names[i], out[i, j]), strict=True))
            order = np.lexsort((t, -k, q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < top]
            kept[ids[0]], asked_ids[ids[0]] = [z[order] for z in (q, k, t, x)], ids
        for first, (q, k, t, x) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked_ids[first][q].astype(t.dtype)), pa.array(t), pa.array(x), pa.array(k)], ["query_id", "target_id", "affinity", "key"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "target_id"))
    return _mapped(matrix, asked, best, "affinity double, key double").withColumn("_k", rank).where(F.col("_k") <= top).select("query_id", "target_id", "affinity")
