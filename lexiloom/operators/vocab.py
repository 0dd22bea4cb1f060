"""Vocabulary: word counts, ranks as ids, frequency statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.tables import numbered

#: Occurrence thresholds of the statistics report, fixed values.
OCCURRENCES = (10000, 5000, 1000, 500, 100, 50, 10, 5, 4, 3, 2)


def counts(corpus: DataFrame, *by: str) -> DataFrame:
    """(by..., word, freq) of a tokenized corpus (toks); partial counts are taken before the shuffle."""
    words = corpus.select(*by, F.explode("toks").alias("word"))
    return words.groupBy(*by, "word").agg(F.count("*").alias("freq"))


def with_ids(vocab: DataFrame) -> DataFrame:
    """vocab (word, freq) with word_id, the rank from 0 by falling frequency and then by word; words are numbered range by range."""
    return numbered(vocab.select("word", "freq"), [F.desc("freq"), F.col("word")], "word_id").withColumn("word_id", F.col("word_id").cast("int"))


def top(vocab: DataFrame, n: int) -> DataFrame:
    """The n most frequent words, as a report."""
    return vocab.orderBy(F.desc("freq"), "word").limit(n)


def totals(vocab: DataFrame) -> DataFrame:
    """(n_types, n_tokens)."""
    return vocab.agg(F.count("*").alias("n_types"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_tokens"))


def relative_frequency(vocab: DataFrame) -> DataFrame:
    """vocab with prob = freq / all tokens."""
    return vocab.crossJoin(F.broadcast(totals(vocab).select("n_tokens"))).select(*vocab.columns, F.try_divide("freq", "n_tokens").alias("prob"))  # one row


def probability_thresholds(vocab: DataFrame, digits: int = 7) -> DataFrame:
    """(threshold, n_types): words of probability at least 1, 0.1, 0.01 and so on, for thresholds that some word falls under."""
    k = F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("k")
    least = F.pow(F.lit(10), F.col("k")).cast("long")  # freq / total >= 10 ** -k, without a division
    v = vocab.crossJoin(F.broadcast(totals(vocab).select("n_tokens"))).select("freq", "n_tokens", k)  # one row; then digits + 1 a word, added up at once
    reach = (F.col("freq") * least >= F.col("n_tokens")).cast("long")
    found = v.groupBy("k").agg(F.sum(reach).alias("n_types"), F.count("*").alias("n"))
    return found.where("n_types < n").select(F.pow(F.lit(10.0), -F.col("k")).alias("threshold"), "n_types")


def occurrence_thresholds(vocab: DataFrame, thresholds: Sequence[int] = OCCURRENCES) -> DataFrame:
    """(threshold, n_types): words that occur at least so often."""
    sums = vocab.agg(*[F.coalesce(F.sum((F.col("freq") >= t).cast("long")), F.lit(0)).alias(f"t{t}") for t in thresholds])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{t}").alias("n_types")) for t in thresholds]))
    return sums.select(pairs.alias("r")).select("r.*")


def targets(vocab: DataFrame, min_freq: int) -> DataFrame:
    """Words frequent enough to be targets."""
    if min_freq < 1:
        raise ValueError("min_freq must be positive")
    return vocab.where(F.col("freq") >= min_freq)


def check_band(lower: float, upper: float) -> None:
    if not 0 <= lower <= 1 or not 0 <= upper <= 1 or upper <= lower:
        raise ValueError("0 <= lower < upper <= 1 is needed")


def context_band(vocab: DataFrame, upper: float = 1.0, lower: float = 1e-5, inclusive_tail: bool = False) -> DataFrame:
    """(word, freq, word_id, ctx_id) of words with a probability in [lower, upper], in rank order.

    inclusive_tail adds the most frequent word below lower, as an inclusive upper rank would.
    """
    check_band(lower, upper)
    total = F.broadcast(totals(vocab).select("n_tokens"))  # one row
    p: Column = F.col("freq") / F.col("n_tokens")
    bounds = vocab.crossJoin(total).agg(F.sum((p > upper).cast("long")).alias("first"), F.sum((p >= lower).cast("long")).alias("next"))
    last = F.col("next") if inclusive_tail else F.col("next") - 1
    v = vocab.crossJoin(F.broadcast(bounds)).where((F.col("word_id") >= F.col("first")) & (F.col("word_id") <= last))  # one row
    return v.select("word", "freq", "word_id", (F.col("word_id") - F.col("first")).cast("int").alias("ctx_id"))


def context_list(vocab: DataFrame, listed: DataFrame, strict: bool = True) -> DataFrame:
    """(word, freq, word_id, ctx_id) of a given list (id, word); of a repeated word the last id counts."""
    listed = listed.groupBy("word").agg(F.max("id").cast("int").alias("ctx_id"))
    if strict and not (unknown := listed.join(vocab, "word", "left_anti").select("word").limit(5)).isEmpty():
        raise ValueError(f"words of the context list aren't in the vocabulary: {[r.word for r in unknown.collect()]}")
    return vocab.join(listed, "word").select("word", "freq", "word_id", "ctx_id")
