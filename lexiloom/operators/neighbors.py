"""Exact nearest neighbours of stated queries by Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.embed import check_aligned

#: Queries compared with all rows in one pass; more queries take more passes.
QUERIES = 4096
DIGITS = 9


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, d2) of the top rows nearest to each row of queries (id), itself left out by id.

    Each task keeps a query's best of its rows; these few are ranked by squared distance, rounded
    so that equal vectors tie, and by id. Queries are a list of words, gathered in blocks of QUERIES.
    """
    if top < 1:
        raise ValueError("top must be positive")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = v.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id").orderBy("id")
    found = None
    block: list = []
    rows = asked.toLocalIterator()
    while True:
        row = next(rows, None)
        if row is not None:
            block.append((row.id, row.v))
        if block and (row is None or len(block) == QUERIES):
            part = _block(v, block, top)
            found = part if found is None else found.union(part)
            block = []
        if row is None:
            break
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbor_id")).cast("int")
    return found.select("query_id", rank.alias("rank"), "neighbor_id", "d2").where(F.col("rank") <= top)


def _block(v: DataFrame, block: list, top: int) -> DataFrame:
    shipped = v.sparkSession.sparkContext.broadcast((np.array([i for i, _ in block]), np.array([x for _, x in block])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shipped.value
        for batch in batches:
            x, names = np.stack(batch["v"].to_numpy()), batch["id"].to_numpy()
            out = []
            for a in range(0, len(q), 256):
                rough = (q[a : a + 256] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q[a : a + 256] @ x.T
                k = min(top + 2, len(x))
                near = np.argpartition(rough, k - 1, axis=1)[:, :k]
                reach = np.take_along_axis(rough, near, axis=1).max(axis=1) + 10.0**-DIGITS
                i, j = (rough <= reach[:, None]).nonzero()  # ties of the last place too
                d2 = np.round(((q[a + i] - x[j]) ** 2).sum(axis=1), DIGITS)
                keep = ids[a + i] != names[j]
                out.append(pd.DataFrame({"query_id": ids[a + i][keep], "neighbor_id": names[j][keep], "d2": d2[keep]}))
            yield pd.concat(out)

    return v.mapInPandas(run, "query_id long, neighbor_id long, d2 double")


def listed(vectors: DataFrame, names: DataFrame, words: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(word, line) for each known word of words (word): "word --> n1, n2, ..."; unknown words are skipped. names (id, word) has the ids of vectors."""
    check_aligned(names, vectors, id_col, "id")
    known = words.select("word").distinct().join(names, "word").select("id", "word")
    found = nearest(vectors, known.select("id"), top, id_col, vector_col)
    of = names.select(F.col("id").alias("neighbor_id"), F.col("word").alias("neighbor"))
    named = found.join(of, "neighbor_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))).alias("n"))  # top at most
    line = F.concat(F.col("word"), F.lit(" --> "), F.array_join(F.transform("n", lambda x: x["neighbor"]), ", "))
    return named.join(known, named["query_id"] == known["id"]).select("word", line.alias("line"))


def unknown_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """(word): the words asked for that have no vector."""
    return words.select("word").distinct().join(names, "word", "left_anti")


def sample_words(names: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """n words drawn at random, the same ones for a seed."""
    return names.orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(n)
