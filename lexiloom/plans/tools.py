"""The steps from a corpus to evaluated vectors one by one, each from stored results to stored results.

Every step takes a session and paths; `python -m lexiloom STEP --help` is the same from a shell.
A folder of counts holds cooc (target_id, ctx_id, val), targets and contexts (word, word_id or
ctx_id) as Parquet, the two word lists as text, and the options; svd holds a decomposition, and
a table of vectors has (word_id, word, vec).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import cooc, embed, evaluate, neighbors
from lexiloom.operators import vocab as V
from lexiloom.operators.svd import truncated_svd
from lexiloom.sources import interchange as io
from lexiloom.sources.tables import durable


def tokenized(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, toks) of a cleaned corpus, a sentence a line."""
    return T.corpus(io.check_not_empty(io.read_corpus(spark, path), path), lower=False, digit=False)


def preprocess(spark: SparkSession, input_file: str, output_file: str = "clean_data", lower: bool = True, digit: bool = True, gzip: bool = False) -> None:
    lines = io.check_not_empty(io.read_lines(spark, input_file), input_file)
    io.write_lines(lines.select(T.preprocess(F.col("value"), lower, digit).alias("line")), output_file, gzip=gzip)


def vocab(spark: SparkSession, input_file: str, vocab_file: str = "vocab.txt") -> None:
    io.write_lines(io.vocab_lines(V.counts(tokenized(spark, input_file))), vocab_file)


def stats(spark: SparkSession, vocab_file: str = "vocab.txt") -> DataFrame:
    """(kind, threshold, n): types and tokens, types by least probability and by least occurrences."""
    words = io.read_vocab(spark, vocab_file)
    totals = V.totals(words).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("double").alias("threshold"), F.col(c).alias("n")) for k, c in (("types", "n_types"), ("tokens", "n_tokens"))])).alias("r")).select("r.*")
    named = [(V.probability_thresholds(words), "probability"), (V.occurrence_thresholds(words), "occurrences")]
    for found, kind in named:
        totals = totals.unionByName(found.select(F.lit(kind).alias("kind"), F.col("threshold").cast("double").alias("threshold"), F.col("n_types").alias("n")))
    return totals


def cooccurrence(
    spark: SparkSession, input_file: str, vocab_file: str = "vocab.txt", output_dir: str = "counts", cxt_file: str | None = None, min_freq: int = 100, upper_bound: float = 1.0,
    lower_bound: float = 1e-5, cxt_size: int = 5, dyn_cxt: bool = False, inclusive_tail: bool = False,
) -> None:
    words = durable(io.read_vocab(spark, vocab_file), "vocab")
    targets = V.targets(words, min_freq)
    contexts = V.context_list(words, io.read_words(spark, cxt_file)) if cxt_file else V.context_band(words, upper_bound, lower_bound, inclusive_tail)
    pairs = durable(cooc.cooccurrence(tokenized(spark, input_file), targets, contexts, cxt_size, dyn_cxt), "cooc")
    found = cooc.found_targets(pairs, targets)
    pairs.write.parquet(f"{output_dir}/cooc")
    found.write.parquet(f"{output_dir}/targets")
    contexts.select("word", "ctx_id").write.parquet(f"{output_dir}/contexts")
    io.write_words(found, f"{output_dir}/target_words.txt", "word_id")
    io.write_words(contexts, f"{output_dir}/context_words.txt", "ctx_id")
    options = {"VOCAB_FILE": vocab_file, "CONTEXT_FILE": cxt_file or "none", "MIN_FREQ": min_freq, "UPPER_BOUND": upper_bound, "LOWER_BOUND": lower_bound, "CONTEXT_SIZE": cxt_size, "DYNAMIC_CONTEXT": int(dyn_cxt)}
    io.write_options(io.options_table(spark, options), f"{output_dir}/options.txt")


def matrix_of(spark: SparkSession, counts_dir: str) -> tuple[DataFrame, int, int]:
    """The Hellinger matrix's rows, their number and the number of contexts."""
    rows = durable(cooc.csr(cooc.hellinger(spark.read.parquet(f"{counts_dir}/cooc"))), "rows")
    return io.check_not_empty(rows, counts_dir), rows.count(), spark.read.parquet(f"{counts_dir}/contexts").count()


def pca(spark: SparkSession, input_dir: str = "counts", output_dir: str | None = None, rank: int = 300, method: str = "randomized") -> None:
    io.write_svd(truncated_svd(*matrix_of(spark, input_dir), rank, method), output_dir or f"{input_dir}/svd")


def embeddings(spark: SparkSession, input_dir: str = "counts", svd_dir: str | None = None, output_name: str = "words", dim: int = 100, eig: float = 0.0, norm: bool = False) -> None:
    svd = io.read_svd(spark, svd_dir or f"{input_dir}/svd")
    _named(spark, input_dir, embed.embeddings(svd, dim, eig, norm)).write.parquet(output_name)


def inference(spark: SparkSession, cooc_dir: str, pca_dir: str = "counts/svd", output_name: str = "inference_words", dim: int = 100, eig: float = 0.0, norm: bool = False) -> None:
    """Vectors of the targets of other counts over the same contexts."""
    svd = io.read_svd(spark, pca_dir)
    rows, _, n_cols = matrix_of(spark, cooc_dir)
    if n_cols != len(svd.v):
        raise ValueError(f"{n_cols} contexts, but the decomposition has {len(svd.v)}")
    _named(spark, cooc_dir, embed.fold_in(rows, svd, dim, eig, norm)).write.parquet(output_name)


def _named(spark: SparkSession, counts_dir: str, vectors: DataFrame) -> DataFrame:
    targets = spark.read.parquet(f"{counts_dir}/targets")
    return embed.named(targets, vectors)


def evaluation(spark: SparkSession, word_file: str, pairs: Mapping[str, str] | None = None, questions: Mapping[str, str] | None = None, lower: bool = True, n_categories: int | None = None) -> DataFrame:
    """The report of evaluate.report for data sets {name: file of pairs} and {category: file of questions}; those left out are switched off."""
    vectors = durable(spark.read.parquet(word_file).select("word", "vec"), "vectors")
    asked = [io.read_pairs(spark, path, name) for name, path in (pairs or {}).items()]
    puzzles = [io.read_questions(spark, path, name) for name, path in (questions or {}).items()]
    empty_pairs, empty_questions = (spark.createDataFrame([], s) for s in ("dataset string, w1 string, w2 string, gold double", "category string, a string, b string, c string, d string"))
    for df in asked:
        empty_pairs = empty_pairs.union(df)
    for df in puzzles:
        empty_questions = empty_questions.union(df)
    return evaluate.report(vectors, durable(empty_pairs, "pairs"), durable(empty_questions, "questions"), lower, n_categories)


def nearest(spark: SparkSession, word_file: str, list_file: str, top: int = 10) -> DataFrame:
    """(word, line) of the words of a list; unknown words have the line null."""
    vectors = durable(spark.read.parquet(word_file), "vectors")
    names, words = vectors.select(F.col("word_id").alias("id"), "word"), io.read_words(spark, list_file)
    found = neighbors.listed(vectors, names, words, top, "word_id", "vec")
    return found.unionByName(neighbors.unknown_words(names, words).select("word", F.lit(None).cast("string").alias("line")))
