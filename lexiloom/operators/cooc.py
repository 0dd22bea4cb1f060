"""Windowed co-occurrence counts and the matrix of square-rooted context probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import BROADCAST_ROWS, numbered, parts, small

#: Added to a row's sum before its probabilities are taken, a fixed value.
EPSILON = 0.001
#: Tokens of a line that are handled together.
CHUNK = 64
#: Tokens that counted_rows() looks at together, and counts that one of its tasks holds at most before it hands them on.
TOKENS, HELD = 1 << 19, 1 << 22


def cooccurrence(corpus: DataFrame, targets: DataFrame, contexts: DataFrame, window: int = 5, dynamic: bool = False) -> DataFrame:
    """(target_id, ctx_id, val) of a tokenized corpus (toks).

    contexts (word, ctx_id) are joined right after the window is opened, so that only accepted pairs are
    counted; targets (word, word_id) before it, where they are few enough to broadcast. More targets
    than that are joined after the counting, so that no token is shuffled, only counts, and a target
    has at most a row for each context. Positions count all tokens of a line, unknown
    ones too, and a window never leaves its line. dynamic weighs a pair (window + 1 - distance) /
    window; the numerators are summed as integers, so the result doesn't depend on an order.
    """
    if window < 1:
        raise ValueError("window must be positive")
    # lines in parts of CHUNK centres with a window of margin, so that what is copied for a token is bounded
    lead = lambda at: F.least(at, F.lit(window))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(CHUNK)),
        lambda at: F.struct(lead(at).alias("lead"), F.slice("toks", at - lead(at) + 1, lead(at) + CHUNK + window).alias("part")),
    )
    tokens = corpus.select(F.inline(parts)).select("lead", "part", F.posexplode("part").alias("j", "word"))
    tokens = tokens.where((F.col("j") >= F.col("lead")) & (F.col("j") < F.col("lead") + CHUNK))
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = targets.select("word", "word_id")
    centres = tokens.join(F.broadcast(ids), "word") if few else tokens
    name = "word_id" if few else "word"
    first = F.greatest(F.col("j") - window, F.lit(0))
    around = F.slice("part", first + 1, F.col("j") - first + window + 1)
    pairs = centres.select(F.col(name).alias("target_id"), (F.col("j") - first).alias("before"), F.posexplode(around).alias("at", "word")).where("at <> before")
    pairs = pairs.join(small(contexts.select("word", "ctx_id")), "word")
    weight = F.sum(F.lit(window + 1) - F.abs(F.col("at") - F.col("before"))) / window if dynamic else F.count("*")
    counted = pairs.groupBy("target_id", "ctx_id").agg(weight.cast("double").alias("val"))
    return counted if few else counted.join(ids, counted["target_id"] == ids["word"]).select(F.col("word_id").alias("target_id"), "ctx_id", "val")


def found_targets(cooc: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word_id, word) of targets that have a context at all."""
    return vocab.join(cooc.select(F.col("target_id").alias("word_id")).distinct(), "word_id", "left_semi").select("word_id", "word")


def row_sums(cooc: DataFrame) -> DataFrame:
    return cooc.groupBy("target_id").agg(F.sum("val").alias("total"))


def hellinger(cooc: DataFrame) -> DataFrame:
    """(target_id, ctx_id, a): a = sqrt(val / (row's sum + EPSILON)). Every row has its own sum."""
    total = F.sum("val").over(Window.partitionBy("target_id"))
    return cooc.select("target_id", "ctx_id", F.sqrt(F.col("val") / (total + EPSILON)).alias("a"))


def shape(cooc: DataFrame) -> DataFrame:
    """(n_rows, n_cols, nnz); n_cols is the greatest context id plus one."""
    return cooc.agg(F.countDistinct("target_id").alias("n_rows"), (F.max("ctx_id") + 1).cast("long").alias("n_cols"), F.count("*").alias("nnz"))


def dense_rows(targets: DataFrame) -> DataFrame:
    """(word_id, word, row_id): distinct word ids numbered from 0 in their order, range by range."""
    rows = numbered(targets.select("word_id").distinct(), [F.col("word_id")], "row_id")
    return targets.join(rows.withColumn("row_id", F.col("row_id").cast("int")), "word_id").select(*targets.columns, "row_id")


def csr(matrix: DataFrame) -> DataFrame:
    """(target_id, idx, val): one row of the sparse matrix for each target, columns ascending."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("ctx_id").alias("idx"), F.col("a").alias("val"))))  # at most one for each context
    found = matrix.groupBy("target_id").agg(entries.alias("e"))
    return found.select("target_id", F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["val"]).alias("val"))


def _added(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, sums of n; without n: how often each occurs)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)) if n is None else np.add.reduceat(n, first) if len(first) else n


def _around(word: np.ndarray, ctx: np.ndarray, line: np.ndarray, window: int, n_ctx: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(word * n_ctx + context, how often) of the pairs of one line at most window apart that begin in the first upto tokens; ctx is -1 where a token is no context."""
    keys = [np.zeros(0, np.int64)]
    for d in range(1, window + 1):
        i = np.arange(max(0, min(upto, len(word) - d)))
        i = i[line[i] == line[i + d]]
        for centre, other in ((i, i + d), (i + d, i)):
            met = ctx[other] >= 0
            keys.append(word[centre[met]] * n_ctx + ctx[other[met]])
    return _added(np.concatenate(keys))


def _packed(words: pa.Array, keys: np.ndarray, n: np.ndarray, n_ctx: int, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """(word, c, n) of ascending keys: for a word its contexts, of the given kind, and their counts, a byte each; greater counts are repeated contexts."""
    times = (n + 254) // 255
    last = np.cumsum(times) - 1
    count = np.full(int(times.sum()), 255, np.uint8)
    count[last] = n - (times - 1) * 255
    word, ctx = np.divmod(np.repeat(keys, times), n_ctx)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    ends = np.append(first, len(word))
    binary = lambda x, width: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends * width), pa.py_buffer(x)]).cast(pa.binary())
    found = pa.RecordBatch.from_arrays([words.take(pa.array(word[first])), binary(ctx.astype(kind), kind.itemsize), binary(count, 1)], ["word", "c", "n"])
    yield from (found.slice(i, 10_000) for i in range(0, found.num_rows, 10_000))


def counted_rows(corpus: DataFrame, targets: DataFrame, contexts: DataFrame, window: int = 5) -> DataFrame:
    """(target_id, idx, n, total): the counts of cooccurrence() and their sum as one row for each target that has any, contexts ascending.

    Each task adds its lines up and hands on a row for a word, with two bytes for a context (four, if there are more
    than 65,536) and one for its count, so that no pair of ids is shuffled, spilled or sorted as a row of its own. Targets
    are joined to these rows. contexts, a band or a list, are shipped to the tasks.
    """
    if window < 1:
        raise ValueError("window must be positive")
    spark = corpus.sparkSession
    listed = contexts.select("word", "ctx_id").toPandas()
    n_ctx = int(listed["ctx_id"].max()) + 1 if len(listed) else 1
    kind = np.dtype("<u2" if n_ctx <= 1 << 16 else "<u4")
    shipped = spark.sparkContext.broadcast((pa.array(listed["word"], pa.string()), listed["ctx_id"].to_numpy(np.int64)))
    tokens, held = TOKENS, HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx_words, ctx_ids = shipped.value
        ids_of = np.append(ctx_ids, -1)
        words, found, waiting, n_waiting = pa.array([], pa.string()), [], [], 0

        def look(lists: pa.Array) -> None:
            nonlocal words
            enc = lists.flatten().cast(pa.string()).dictionary_encode()
            if not len(enc):
                return
            at = pc.index_in(enc.dictionary, words)
            new = enc.dictionary.filter(at.is_null())
            place = at.fill_null(-1).to_numpy().astype(np.int64)
            place[place < 0] = len(words) + np.arange(len(new))
            words = pa.concat_arrays([words, new])
            token = enc.indices.to_numpy()
            ctx = ids_of[pc.index_in(enc.dictionary, ctx_words).fill_null(len(ctx_ids)).to_numpy()]
            line = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
            for a in range(0, len(token), tokens):  # a line may be longer than that
                part = slice(a, a + tokens + window)
                found.append(_around(place[token[part]], ctx[token[part]], line[part], window, n_ctx, tokens))

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return _added(*map(np.concatenate, zip(*found, strict=True)))

        for batch in batches:
            lists, lo = batch.column(0), 0
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + tokens - n_waiting, "right")))
                waiting.append(lists.slice(lo, hi - lo))
                n_waiting += int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
                lo = hi
                if n_waiting >= tokens or lo < len(lists):
                    look(pa.concat_arrays(waiting))
                    waiting, n_waiting = [], 0
            if sum(len(k) for k, _ in found) > held:
                found = [joined()]
                if len(found[0][0]) > held * 3 // 4:
                    yield from _packed(words, *found[0], n_ctx, kind)
                    words, found = words[:0], []
        if waiting:
            look(pa.concat_arrays(waiting))
        if found:
            yield from _packed(words, *joined(), n_ctx, kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a target come one after the other; the last one may go on."""
        ids, ctx, n = (np.zeros(0, np.int64) for _ in range(3))

        def rows(upto: int) -> pa.RecordBatch:
            first = np.flatnonzero(np.diff(ids[:upto], prepend=-1))
            ends = pa.array(np.append(first, upto).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids[first].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(ctx[:upto].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n[:upto])), pa.array(np.add.reduceat(n[:upto], first))], ["target_id", "idx", "n", "total"])

        for batch in batches:
            some, c, k = batch.columns
            widths = pc.binary_length(k).to_numpy().astype(np.int64)
            ends = np.cumsum(widths)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + held // 4, "right")))
                ids = np.append(ids, np.repeat(some.slice(lo, hi - lo).to_numpy().astype(np.int64), widths[lo:hi]))
                ctx = np.append(ctx, np.frombuffer(b"".join(c.slice(lo, hi - lo).to_pylist()), kind).astype(np.int64))
                n = np.append(n, np.frombuffer(b"".join(k.slice(lo, hi - lo).to_pylist()), np.uint8).astype(np.int64))
                keys, n = _added(ids * n_ctx + ctx, n)
                ids, ctx = np.divmod(keys, n_ctx)
                upto = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
                if upto:
                    yield rows(upto)
                    ids, ctx, n = ids[upto:], ctx[upto:], n[upto:]
                lo = hi
        if len(ids):
            yield rows(len(ids))

    packed = corpus.select("toks").mapInArrow(count, "word string, c binary, n binary").repartition(parts(spark), "word")
    named = packed.join(targets.select("word", "word_id"), "word").select(F.col("word_id").cast("int").alias("target_id"), "c", "n")
    # a word's rows are all in its partition, and a join keeps them there
    return named.sortWithinPartitions("target_id").mapInArrow(whole, "target_id int, idx array<int>, n array<bigint>, total bigint")


def hellinger_rows(counts: DataFrame) -> DataFrame:
    """(target_id, idx, val) of counted_rows(): the rows of hellinger()."""
    return counts.select("target_id", "idx", F.transform("n", lambda x: F.sqrt(x / (F.col("total") + EPSILON))).alias("val"))
