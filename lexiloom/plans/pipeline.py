"""From a corpus to word vectors, with all options in one place."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import corpus
from lexiloom.operators import cooc, embed, vocab
from lexiloom.operators.svd import Svd, truncated_svd
from lexiloom.sources.interchange import check_not_empty, options_table
from lexiloom.sources.tables import durable, spread


@dataclass(frozen=True)
class Options:
    """Every parameter of a run, with its default."""

    lower: bool = True
    digit: bool = True
    min_freq: int = 100
    upper_bound: float = 1.0
    lower_bound: float = 1e-5
    inclusive_tail: bool = False
    window: int = 5
    dynamic: bool = False
    rank: int = 300
    dim: int = 100
    eig: float = 0.0
    normalize: bool = False
    method: str = "randomized"

    def __post_init__(self):
        vocab.check_band(self.lower_bound, self.upper_bound)
        if self.min_freq < 1 or self.window < 1 or self.rank < 1:
            raise ValueError("min_freq, window and rank must be positive")
        if not 1 <= self.dim <= self.rank:
            raise ValueError("dim must be from 1 to rank")
        if not 0 <= self.eig <= 1:
            raise ValueError("eig must be from 0 to 1")
        if self.method not in ("randomized", "gram"):
            raise ValueError("method must be randomized or gram")


@dataclass
class Counts:
    """Tables of the counting stages."""

    vocab: DataFrame
    targets: DataFrame
    contexts: DataFrame
    cooc: DataFrame


def _words(docs: DataFrame, options: Options, context_words: DataFrame | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tokenized docs, vocabulary, targets, contexts)."""
    tokenized = corpus(spread(docs.select(id_col, text_col)), id_col, text_col, options.lower, options.digit)
    words = durable(vocab.with_ids(vocab.counts(tokenized)), "vocab")
    check_not_empty(words, "the corpus")
    targets = vocab.targets(words, options.min_freq)
    contexts = vocab.context_band(words, options.upper_bound, options.lower_bound, options.inclusive_tail) if context_words is None else vocab.context_list(words, context_words)
    return tokenized, words, targets, contexts


def hellinger_rows(docs: DataFrame, options: Options, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(target_id, idx, val): the Hellinger matrix of docs by rows, from counts that are made and kept by rows too; pairs weigh the same at all distances."""
    if options.dynamic:
        raise ValueError("counts by rows don't weigh distances")
    tokenized, _, targets, contexts = _words(docs, options, None, id_col, text_col)
    return cooc.hellinger_rows(durable(cooc.counted_rows(tokenized, targets, contexts, options.window), "counts"))


def count(docs: DataFrame, options: Options, context_words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Counts:
    """Vocabulary, targets, contexts and co-occurrences of docs; context_words (id, word) replaces the frequency band."""
    tokenized, words, targets, contexts = _words(docs, options, context_words, id_col, text_col)
    pairs = durable(cooc.cooccurrence(tokenized, targets, contexts, options.window, options.dynamic), "cooc")
    return Counts(words, targets, contexts, pairs)


def decompose(counts: Counts, options: Options) -> Svd:
    n_cols = counts.contexts.count()
    rows = durable(cooc.csr(cooc.hellinger(counts.cooc)), "rows")
    n_rows = rows.count()
    return truncated_svd(rows, n_rows, n_cols, min(options.rank, n_rows, n_cols), options.method)


def learn(docs: DataFrame, options: Options) -> tuple[Counts, Svd, DataFrame]:
    """Counts, decomposition, and the words' vectors (word_id, word, vec)."""
    counts = count(docs, options)
    svd = decompose(counts, options)
    vectors = embed.embeddings(svd, min(options.dim, len(svd.s)), options.eig, options.normalize)
    named = counts.targets.select("word_id", "word").join(vectors.withColumnRenamed("target_id", "word_id"), "word_id")
    return counts, svd, named


def infer(docs: DataFrame, contexts: DataFrame, svd: Svd, options: Options, min_freq: int = 1) -> DataFrame:
    """(word_id, word, vec) of the words of another corpus, folded in over the contexts (word, ctx_id) of svd."""
    if contexts.count() != len(svd.v):
        raise ValueError("the contexts aren't those of the decomposition")
    tokenized = corpus(spread(docs), lower=options.lower, digit=options.digit)
    words = durable(vocab.with_ids(vocab.counts(tokenized)), "vocab")
    pairs = cooc.cooccurrence(tokenized, vocab.targets(words, min_freq), contexts, options.window, options.dynamic)
    vectors = embed.fold_in(cooc.csr(cooc.hellinger(pairs)), svd, min(options.dim, len(svd.s)), options.eig, options.normalize)
    return words.select("word_id", "word").join(vectors.withColumnRenamed("target_id", "word_id"), "word_id")


def manifest(spark, options: Options) -> DataFrame:
    return options_table(spark, asdict(options)).select("key", F.col("value"))
