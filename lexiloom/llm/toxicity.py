"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model on the presence of words and word beginnings, trained in
numpy from confirmed toxic documents and unlabelled ones. The risk of unlabelled text as
clean is corrected by the class prior times the risk of toxic text as clean; where that
difference falls below zero, which only overfitting can make, its gradient is reversed.

Training reads bounded samples (POSITIVES toxic and UNLABELLED other training documents, the
first by a hash of the id), so it costs the same at any size; scoring reads every text whole.
Features are kept that two toxic documents share and that are far more frequent in toxic
text than in clean text, as the prior divides the unlabelled. They are counted in Spark; the
driver gets the counts of those that two toxic documents share, and of each document only the
features that were kept. The class prior is the toxic share of the training labels, with one
toxic and one clean label added, and at most MOST_PRIOR, so that a text without any feature
counts as clean.

Training rows are those whose crc32 of the id as text isn't divisible by FOLDS; labels of
other rows are never read. Labels, language, source and id are no inputs of a score.

Defined cases: null, empty and wordless texts score as a text without any feature; very long
texts are read whole; a null id counts as the empty string in the fold rule; labels null or
other than 0 and 1 are ignored, of repeated labels any 1 makes a document toxic; ties of the
samples go to the lower id; without toxic training documents every score is the prior;
repeated rows are scored each; a column that has the score's name already is an error; an empty
table has no scores, and without labels the prior is one half or MOST_PRIOR.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import column_bytes, durable, map_arrow, spread, table
from lexiloom.llm.words import SMALL, mix, word_hashes

FOLDS = 5
POSITIVES, UNLABELLED = 1500, 3000
MOST_PRIOR = 0.49
#: Bytes of word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS, RATE, DECAY = 400, 0.05, 1e-4
#: Pull towards 0 of each weight, which leaves only features that carry weight.
SPARSE = 7e-5
#: Smoothing of the selection, in documents, and the log ratio and significance a feature needs.
SMOOTH, RATIO, SIGNIFICANCE = 0.5, 2.5, 4.5
FILTER_BITS = 22
#: Bytes that end a word: ASCII but letters and digits.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def text_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit feature of every word and word beginning of the texts, repeats included."""
    hashes, starts, lengths = word_hashes(data, bounds, SEPARATORS, lower=True)
    rows = np.searchsorted(bounds, starts, side="right") - 1
    packed = np.zeros(len(starts), np.uint64)
    out_rows, out = [rows], [hashes]
    for i in range(max(BEGINNINGS)):
        have = lengths > i
        letters = SMALL[data[np.where(have, starts + i, 0)]] if len(data) else np.zeros(0, np.uint8)
        packed |= np.where(have, letters, 0).astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in BEGINNINGS:
            out_rows.append(rows[have])
            out.append(mix(packed[have] ^ mix(np.full(1, i + 1, np.uint64))))
    return np.concatenate(out_rows), np.concatenate(out)


@dataclass
class Model:
    """Features in ascending order, their weights, the intercept and the prior it was trained with."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.full(len(bounds) - 1, self.bias)
        if not len(self.features) or not len(data):
            return total
        known = np.zeros(1 << FILTER_BITS, bool)
        shift = np.uint64(64 - FILTER_BITS)
        known[self.features >> shift] = True
        rows, found = text_features(data, bounds)
        maybe = known[found >> shift]
        rows, found = rows[maybe], found[maybe]
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        exact = self.features[at] == found
        seen = np.unique(rows[exact].astype(np.int64) * len(self.features) + at[exact])
        np.add.at(total, seen // len(self.features), self.weights[seen % len(self.features)])
        return total


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose(names: np.ndarray, in_toxic: np.ndarray, in_other: np.ndarray, n_toxic: int, n_other: int, prior: float) -> np.ndarray:
    """The features, ascending, that set toxic texts apart from what the prior leaves of the unlabelled as clean; counted in so many texts of each kind."""
    share, base = (in_toxic + SMOOTH) / (n_toxic + 1), (in_other + SMOOTH) / (n_other + 1)
    clean = np.maximum(base - prior * share, SMOOTH / (n_other + 1)) / (1 - prior)
    ratio = np.log(share / clean)
    pooled = (in_toxic + in_other + SMOOTH) / (n_toxic + n_other + 1)
    chance = np.sqrt(pooled * (1 - pooled) * (1 / max(n_toxic, 1) + 1 / max(n_other, 1)))  # deviation of the difference of two shares
    return np.sort(names[(in_toxic >= 2) & (ratio > RATIO) & ((share - base) / chance > SIGNIFICANCE)])


def select_features(toxic: list[np.ndarray], other: list[np.ndarray], prior: float) -> np.ndarray:
    """choose() from the distinct features of each text."""
    if not toxic:
        return np.zeros(0, np.uint64)
    names, in_toxic = np.unique(np.concatenate(toxic), return_counts=True)
    found, count = np.unique(np.concatenate(other), return_counts=True) if other else (names[:0], in_toxic[:0])
    at = np.minimum(np.searchsorted(found, names), max(len(found) - 1, 0))
    in_other = np.where(found[at] == names, count[at], 0) if len(found) else np.zeros(len(names), np.int64)
    return choose(names, in_toxic, in_other, len(toxic), len(other), prior)


#: Texts by their features: row numbers, feature numbers, and how many texts.
Sparse = tuple[np.ndarray, np.ndarray, int]


def sparse(numbers: list[np.ndarray]) -> Sparse:
    rows = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    return rows, np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64), len(numbers)


def numbers_of(features: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the features a text with these distinct ones has."""
    at = np.searchsorted(features, own)
    return at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == own)] if len(features) else at[:0]


def forward(w: np.ndarray, x: Sparse) -> np.ndarray:
    return np.bincount(x[0], w[x[1]], x[2]) + w[-1]


def risks(w: np.ndarray, p: Sparse, u: Sparse, prior: float) -> tuple[float, float]:
    """The risks of toxic texts as toxic, and of clean ones as clean as the unlabelled and the prior tell it."""
    zp, zu = forward(w, p), forward(w, u)
    as_clean = np.logaddexp(0, zu).mean() if u[2] else 0.0
    return prior * float(np.logaddexp(0, -zp).mean()), float(as_clean - prior * np.logaddexp(0, zp).mean())


def descent(w: np.ndarray, p: Sparse, u: Sparse, prior: float) -> np.ndarray:
    """The gradient of the sum of both risks, or, where the second is below any true one, of its opposite."""

    def back(x: Sparse, g: np.ndarray) -> np.ndarray:
        g = g / max(x[2], 1)
        return np.append(np.bincount(x[1], g[x[0]], len(w) - 1), g.sum())

    sp = sigmoid(forward(w, p))
    negative = back(u, sigmoid(forward(w, u))) - prior * back(p, sp)
    return -negative if risks(w, p, u, prior)[1] < 0 else prior * back(p, sp - 1) + negative


def weigh(features: np.ndarray, p: Sparse, u: Sparse, prior: float) -> Model:
    """The model of these features, from toxic and unlabelled texts."""
    bias = float(np.log(prior / (1 - prior)))
    if not len(features):
        return Model(features, np.zeros(0), bias, prior)
    w = np.zeros(len(features) + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        gradient = descent(w, p, u, prior)
        gradient[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = RATE * (1 - (step - 1) / STEPS)  # falling, so that the reversals die away
        scale = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= scale * (first / (1 - 0.9**step))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - scale[:-1] * SPARSE, 0)
    return Model(features, w[:-1].copy(), float(w[-1]), prior)


def train(toxic: list[np.ndarray], other: list[np.ndarray], prior: float) -> Model:
    """The model from the distinct features of toxic and of unlabelled texts."""
    features = select_features(toxic, other, prior)
    return weigh(features, *(sparse([numbers_of(features, f) for f in texts]) for texts in (toxic, other)), prior)


def in_fold(id_col: Column) -> Column:
    """Whether a row is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train from the labels of rows that aren't held out, and unlabelled documents of the same rows."""
    known = labels.where(~in_fold(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).alias("y"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(MOST_PRIOR, (positive + 1) / (n + 2))
    order = F.xxhash64("k")
    toxic_ids = known.where("y = 1").select("k").orderBy(order, "k").limit(POSITIVES)
    ids = docs.where(~in_fold(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"))
    other_ids = ids.distinct().orderBy(order, "k").limit(UNLABELLED)
    wanted = toxic_ids.withColumn("kind", F.lit(1)).union(other_ids.withColumn("kind", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(1))
            rows, found = text_features(data, bounds)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
            rows, found = rows[new], found[new]
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["kind", "features"])

    chosen = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(F.broadcast(wanted), "k").select("kind", "t")  # at most POSITIVES + UNLABELLED ids
    sample = durable(map_arrow(chosen, run, "kind int, features array<long>", 1), "sample")
    kinds = {r.kind: r["count"] for r in sample.groupBy("kind").count().collect()}
    counts = sample.select("kind", F.explode("features").alias("f")).groupBy("f").agg(F.sum("kind").alias("toxic"), F.sum(1 - F.col("kind")).alias("other")).where("toxic >= 2").toArrow()
    names = counts["f"].to_numpy().view(np.uint64)
    features = choose(names, counts["toxic"].to_numpy(), counts["other"].to_numpy(), kinds.get(1, 0), kinds.get(0, 0), prior)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [numbers_of(features, x.values.to_numpy().view(np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["kind", "features"])

    kept = sorted((r.kind, r.features) for r in sample.mapInArrow(known, "kind int, features array<long>").collect())  # of the bounded sample, the chosen features
    p, u = (sparse([np.array(f, np.int64) for kind, f in kept if kind == of]) for of in (1, 0))
    return weigh(features, p, u, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score appended as a column, whose name mustn't be one of theirs."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(at))
            scores = sigmoid(model.logits(data, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, name])

    schema = type(docs.schema)(list(docs.schema.fields)).add(name, "double")
    return map_arrow(spread(docs), run, schema, at)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The columns of docs, without the documents scored at threshold or more."""
    own = "_toxicity_score"
    return score(docs, fit(docs, labels), name=own).where(F.col(own) < threshold).drop(own)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
