"""Registered queries, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import affinity, cooc, embed, evaluate, neighbors, svd, vocab
from lexiloom.plans import pipeline
from lexiloom.sources import interchange as io
from lexiloom.sources.tables import durable, shared_path, spread, table

MIN_FREQ, LOWER, UPPER, WINDOW = 10, 1e-4, 1.0, 5
RANK, DIM = 20, 10
#: The stated query set of searches among targets: every id divisible by this, against all rows.
EVERY = 100
#: Contexts of the matrix whose decomposition is complete, so that SQL can say what its parts add up to.
FULL = 30

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- the same steps in SQL ---------------------------------------------------------------------

ABC = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def sql_tokens(name: str, source: str, key: str, extra: str = "") -> str:
    """Common table expressions ending in {name}(doc_id, line_no, pos, word, extra...)."""
    more = f", {extra}" if extra else ""
    return f"""
{name}_text AS (SELECT {key} AS doc_id{more}, replace(regexp_replace(translate(text, {ABC}), '[0-9][0-9,.]*', '0', 'g'), chr(13), '') AS t FROM {source}),
{name}_line AS (SELECT doc_id{more}, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM {name}_text),
{name}_list AS (SELECT doc_id{more}, line_no, list_filter(string_split_regex(line, '[ \\t]+'), lambda x: x <> '') AS toks FROM {name}_line),
{name} AS (SELECT doc_id{more}, line_no, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM {name}_list)"""


TOKENS = sql_tokens("tok", "documents", "doc_id")
VOCAB = f"""{TOKENS},
vocab AS (SELECT word, freq, (row_number() OVER (ORDER BY freq DESC, word) - 1)::INTEGER AS word_id
          FROM (SELECT word, count(*) AS freq FROM tok GROUP BY word)),
total AS (SELECT count(*) AS n_types, sum(freq)::BIGINT AS n_tokens FROM vocab)"""
BAND = f"""{VOCAB},
target AS (SELECT * FROM vocab WHERE freq >= {MIN_FREQ}),
edge AS (SELECT count(*) FILTER (freq / n_tokens > {UPPER}) AS first, count(*) FILTER (freq / n_tokens >= {LOWER}) AS next FROM vocab, total),
ctx AS (SELECT word, freq, word_id, (word_id - first)::INTEGER AS ctx_id FROM vocab, edge WHERE word_id >= first AND word_id < next)"""


def sql_cooc(value: str, contexts: str = "ctx", corpus: str = "tok", name: str = "cooc") -> str:
    return f"""
{name} AS (SELECT t.word_id AS target_id, c.ctx_id, ({value})::DOUBLE AS val
  FROM {corpus} a JOIN {corpus} b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {WINDOW}
  JOIN target t ON t.word = a.word JOIN {contexts} c ON c.word = b.word GROUP BY t.word_id, c.ctx_id)"""


COOC = f"{BAND},{sql_cooc('count(*)')}"
HELLINGER = f"{COOC}, m AS (SELECT target_id, ctx_id, sqrt(val / (sum(val) OVER (PARTITION BY target_id) + {cooc.EPSILON})) AS a FROM cooc)"


def options() -> pipeline.Options:
    return pipeline.Options(min_freq=MIN_FREQ, lower_bound=LOWER, upper_bound=UPPER, window=WINDOW, rank=RANK, dim=DIM)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.corpus(documents(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.counts(tokenized(spark, sf_dir))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.with_ids(words(spark, sf_dir))


def counted(spark: SparkSession, sf_dir: str, **changes) -> pipeline.Counts:
    return pipeline.count(table(spark, sf_dir, "documents"), pipeline.Options(**{**asdict(options()), **changes}))


# --- cleaning and tokenizing -------------------------------------------------------------------


@query(f"SELECT doc_id, translate(text, {ABC}) AS text FROM documents")
def preprocess_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preprocess(F.col("text"), digit=False).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[0-9][0-9,.]*', '0', 'g') AS text FROM documents")
def preprocess_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preprocess(F.col("text"), lower=False).alias("text"))


@query(f"SELECT doc_id, regexp_replace(translate(text, {ABC}), '[0-9][0-9,.]*', '0', 'g') AS text FROM documents")
def preprocess_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preprocess(F.col("text")).alias("text"))


@query(f"WITH {TOKENS} SELECT doc_id, line_no, array_to_string(toks, ' ') AS line, len(toks) AS n FROM tok_list")
def tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir).select("doc_id", "line_no", F.array_join("toks", " ").alias("line"), F.size("toks").cast("long").alias("n"))


@query("SELECT page_id, string_split(url, '/')[3] AS host FROM pages")
def delimited_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.field(F.col("url"), 2, "/").alias("host"))


@query("SELECT doc_id, translate(text, ',.', '') AS text, ltrim(source, 's') AS source FROM documents")
def drop_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.remove_all(F.col("text"), ",.").alias("text"), T.strip_leading(F.col("source"), "s").alias("source"))


@query("SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS BIGINT) AS number, TRY_CAST(source AS DOUBLE) AS none, regexp_matches(text, '[0-9]') AS digit FROM documents")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = T.parse(F.replace("source", F.lit("src"), F.lit("")), "long")
    return docs.select("doc_id", number.alias("number"), T.parse(F.col("source"), "double").alias("none"), T.has_digit(F.col("text")).alias("digit"))


# --- vocabulary and statistics -----------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT word, count(*) AS freq FROM tok GROUP BY word")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir)


@query(f"WITH {TOKENS} SELECT word, count(*) AS freq FROM tok GROUP BY word ORDER BY freq DESC, word LIMIT 100")
def vocab_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top(words(spark, sf_dir), 100)


@query(f"WITH {VOCAB} SELECT word, freq, word_id FROM vocab")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir)


@query(f"WITH {sql_tokens('tok', 'documents', 'doc_id', 'lang')} SELECT lang, word, count(*) AS freq FROM tok GROUP BY lang, word")
def vocab_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    lines = docs.select("lang", F.explode(F.split(T.preprocess(F.col("text")), "\n")).alias("line"))
    return vocab.counts(lines.select("lang", T.tokens(F.col("line")).alias("toks")), "lang")


@query(f"WITH {sql_tokens('tok', 'conversations', 'conv_id', 'role')} SELECT role, word, count(*) AS freq FROM tok GROUP BY role, word")
def vocab_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations").select("role", "text"))
    lines = turns.select("role", F.explode(F.split(T.preprocess(F.col("text")), "\n")).alias("line"))
    return vocab.counts(lines.select("role", T.tokens(F.col("line")).alias("toks")), "role")


@query(f"WITH {VOCAB} SELECT n_types, n_tokens FROM total")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.totals(words(spark, sf_dir))


@query(
    f"""WITH {VOCAB}, k AS (SELECT unnest(range(0, 8)) AS k),
c AS (SELECT k, count(*) FILTER (freq * (10 ** k)::BIGINT >= n_tokens) AS n_types, count(*) AS n FROM vocab, total, k GROUP BY k)
SELECT round(10.0 ** (-k), 7) AS threshold, n_types FROM c WHERE n_types < n"""
)
def stats_prob_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocab.probability_thresholds(durable(words(spark, sf_dir), "words"))
    return found.select(F.round("threshold", 7).alias("threshold"), "n_types")


@query(f"WITH {VOCAB}, k AS (SELECT unnest({list(vocab.OCCURRENCES)}::BIGINT[]) AS threshold) SELECT threshold, count(*) FILTER (freq >= threshold) AS n_types FROM vocab, k GROUP BY threshold")
def stats_occ_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.occurrence_thresholds(words(spark, sf_dir))


@query(f"WITH {VOCAB} SELECT word, freq, round(freq / n_tokens, 9) AS prob FROM vocab, total")
def relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocab.relative_frequency(durable(words(spark, sf_dir), "words"))
    return found.select("word", "freq", F.round("prob", 9).alias("prob"))


@query(f"WITH {BAND} SELECT word, freq, word_id FROM target")
def targets_minfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.targets(ranked(spark, sf_dir), MIN_FREQ)


@query(f"WITH {BAND} SELECT word, freq, word_id, ctx_id FROM ctx")
def context_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.context_band(durable(ranked(spark, sf_dir), "vocab"), UPPER, LOWER)


@query(f"WITH {BAND} SELECT word, freq, word_id, (word_id - first)::INTEGER AS ctx_id FROM vocab, edge WHERE word_id >= first AND word_id <= next")
def context_band_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.context_band(durable(ranked(spark, sf_dir), "vocab"), UPPER, LOWER, inclusive_tail=True)


# --- co-occurrence -----------------------------------------------------------------------------


@query(f"WITH {COOC} SELECT target_id, ctx_id, val FROM cooc")
def cooc_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).cooc


@query(f"WITH {COOC.replace(f'freq >= {MIN_FREQ}', 'freq >= 100')} SELECT target_id, ctx_id, val FROM cooc")
def cooc_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default least frequency of targets."""
    return counted(spark, sf_dir, min_freq=100).cooc


@query(f"WITH {BAND},{sql_cooc(f'sum({WINDOW + 1} - abs(a.pos - b.pos)) / {WINDOW}')} SELECT target_id, ctx_id, round(val, 6) AS val FROM cooc")
def cooc_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, dynamic=True).cooc.withColumn("val", F.round("val", 6))


#: A predefined list: every seventh word of the band.
LISTED = f"{BAND}, lst AS (SELECT word, (ctx_id // 7)::INTEGER AS ctx_id FROM ctx WHERE ctx_id % 7 = 0)"


@query(f"WITH {LISTED},{sql_cooc('count(*)', 'lst')} SELECT target_id, ctx_id, val FROM cooc")
def cooc_predefined_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = durable(ranked(spark, sf_dir), "vocab")
    band = vocab.context_band(v, UPPER, LOWER).where("ctx_id % 7 = 0")
    contexts = vocab.context_list(v, band.select(F.expr("ctx_id div 7").cast("int").alias("id"), "word"))
    return cooc.cooccurrence(tokenized(spark, sf_dir), vocab.targets(v, MIN_FREQ), contexts, WINDOW)


@query(f"WITH {COOC} SELECT word_id, word FROM target WHERE word_id IN (SELECT target_id FROM cooc)")
def found_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir)
    return cooc.found_targets(c.cooc, c.vocab)


@query(f"WITH {COOC} SELECT target_id, sum(val) AS total FROM cooc GROUP BY target_id")
def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.row_sums(counted(spark, sf_dir).cooc)


@query(f"WITH {HELLINGER} SELECT target_id, ctx_id, round(a, 6) AS a FROM m")
def hellinger_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.hellinger(counted(spark, sf_dir).cooc).withColumn("a", F.round("a", 6))


@query(f"WITH {COOC} SELECT count(DISTINCT target_id) AS n_rows, (max(ctx_id) + 1)::BIGINT AS n_cols, count(*) AS nnz FROM cooc")
def matrix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.shape(counted(spark, sf_dir).cooc)


@query(f"WITH {COOC} SELECT word_id, word, (dense_rank() OVER (ORDER BY word_id) - 1)::INTEGER AS row_id FROM target WHERE word_id IN (SELECT target_id FROM cooc)")
def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir)
    return cooc.dense_rows(cooc.found_targets(c.cooc, c.vocab))


@query(f"WITH {HELLINGER} SELECT target_id, list(ctx_id ORDER BY ctx_id) AS idx, list(round(a, 6) ORDER BY ctx_id) AS val FROM m GROUP BY target_id")
def csr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cooc.csr(cooc.hellinger(counted(spark, sf_dir).cooc))
    return m.select("target_id", "idx", F.transform("val", lambda x: F.round(x, 6)).alias("val"))


SIMILAR = f"{HELLINGER}, s AS (SELECT p.target_id AS query_id, q.target_id, sum(p.a * q.a) AS affinity FROM m p JOIN m q ON p.ctx_id = q.ctx_id WHERE p.target_id % {EVERY} = 0 GROUP BY p.target_id, q.target_id)"


def similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the Hellinger matrix, and those that are queries."""
    m = pipeline.hellinger_rows(table(spark, sf_dir, "documents"), options())
    return m, m.where(F.col("target_id") % EVERY == 0)


@query(f"WITH {SIMILAR} SELECT query_id, target_id, round(affinity, 6) AS affinity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(affinity, 9) DESC, target_id) <= 10")
def bhattacharyya_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = affinity.most_alike(*similar(spark, sf_dir), 10)
    return found.withColumn("affinity", F.round("affinity", 6))


@query(
    f"""WITH {SIMILAR}, n AS (SELECT target_id, sum(a * a) AS n2 FROM m GROUP BY target_id)
SELECT query_id, s.target_id, round(greatest(p.n2 + q.n2 - 2 * affinity, 0), 6) AS d2
FROM s JOIN n p ON p.target_id = s.query_id JOIN n q ON q.target_id = s.target_id"""
)
def hellinger_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.squared_distances(*similar(spark, sf_dir), digits=6)


# --- decompositions and vectors ----------------------------------------------------------------


def sparse_rows(spark: SparkSession, sf_dir: str) -> tuple[pipeline.Counts, DataFrame, int]:
    c = counted(spark, sf_dir)
    return c, durable(cooc.csr(cooc.hellinger(c.cooc)), "rows"), c.contexts.count()


@query(f"WITH {HELLINGER} SELECT p.ctx_id AS i, q.ctx_id AS j, round(sum(p.a * q.a), 6) AS val FROM m p JOIN m q ON p.target_id = q.target_id GROUP BY p.ctx_id, q.ctx_id")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of columns, added within each task's rows before the shuffle."""
    _, rows, n_cols = sparse_rows(spark, sf_dir)
    found = svd.gram_rows(rows, n_cols).select(F.col("k").alias("i"), F.posexplode("vec").alias("j", "val"))
    return found.where("val > 0").withColumn("val", F.round("val", 6))


@query()
def svd_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows, n_cols = sparse_rows(spark, sf_dir)
    n = rows.count()
    found = svd.truncated_svd(rows, n, n_cols, min(RANK, n, n_cols))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(found.s)], "k int, sigma double")


@query(f"WITH {HELLINGER} SELECT round(sum(a * a), 6) AS total FROM m")
def svd_norm_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of all singular values add up to those of all entries; the left side is taken from the Gram matrix's eigenvalues."""
    import numpy as np

    _, rows, n_cols = sparse_rows(spark, sf_dir)
    values = np.linalg.eigvalsh(svd.gram(rows, n_cols))
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "total double")


@query()
def svd_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counted(spark, sf_dir)
    found = embed.embeddings(pipeline.decompose(c, options()), DIM, 0.5, normalize=True)
    return c.vocab.select("word_id", "word").join(found.withColumnRenamed("target_id", "word_id"), "word_id")


@query()
def svd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the uncentred principal components."""
    _, rows, n_cols = sparse_rows(spark, sf_dir)
    n = rows.count()
    return svd.principal_components(rows, n, n_cols, min(DIM, n, n_cols))[0]


@query()
def symmetric_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading eigenvalues, ascending, of the products of columns."""
    _, rows, n_cols = sparse_rows(spark, sf_dir)
    products = svd.gram_rows(rows, n_cols)
    square = products.select(F.col("k").alias("target_id"), F.sequence(F.lit(0), F.size("vec") - 1).alias("idx"), F.col("vec").alias("val"))
    values, _ = svd.symmetric_eigen(durable(square, "square"), n_cols, min(DIM, n_cols))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k int, value double")


@query()
def svd_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the words of conversations, folded in over the contexts of documents."""
    c = counted(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return pipeline.infer(turns, c.contexts, pipeline.decompose(c, options()), options(), min_freq=MIN_FREQ)


# What must hold of decompositions, for all rows: SQL can't decompose, but knows these.


@query(f"SELECT i, j, (i = j)::INTEGER::DOUBLE AS val FROM range({RANK}) a(i), range({RANK}) b(j)")
def svd_left_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the columns of U."""
    found = pipeline.decompose(counted(spark, sf_dir), options())
    return _products(svd.inner_products(found.u, len(found.s)))


@query(f"SELECT i, j, (i = j)::INTEGER::DOUBLE AS val FROM range({RANK}) a(i), range({RANK}) b(j)")
def svd_right_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the columns of V, from the orthonormalised projection."""
    found = pipeline.decompose(counted(spark, sf_dir), options())
    v = spark.createDataFrame([(r.tolist(),) for r in found.v], "vec array<double>")
    return _products(svd.inner_products(v, len(found.s)))


def _products(found: DataFrame) -> DataFrame:
    rounded = found.select(F.col("k").cast("long").alias("i"), F.posexplode("vec").alias("j", "val"))
    return rounded.select("i", F.col("j").cast("long").alias("j"), (F.round("val", 6) + 0.0).alias("val"))


@query(f"WITH {HELLINGER} SELECT DISTINCT target_id, 0.0::DOUBLE AS residual FROM m")
def svd_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of A V - U S for each row."""
    c, rows, n_cols = sparse_rows(spark, sf_dir)
    n = rows.count()
    found = svd.truncated_svd(rows, n, n_cols, min(RANK, n, n_cols))
    av = svd.project(rows, found.v).withColumnRenamed("vec", "av")
    s = F.array(*[F.lit(float(x)) for x in found.s])
    away = F.zip_with("av", V.scale_each(F.col("vec"), s), lambda a, b: a - b)
    return found.u.join(av, "target_id").select("target_id", (F.round(F.sqrt(V.dot(away, away)), 6) + 0.0).alias("residual"))


FULL_ROWS = f"{HELLINGER}, f AS (SELECT * FROM m WHERE ctx_id < {FULL})"


def full_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    m = cooc.hellinger(counted(spark, sf_dir).cooc).where(F.col("ctx_id") < FULL)
    rows = durable(cooc.csr(m), "rows")
    return rows, rows.count(), FULL


def lengths(vectors: DataFrame) -> DataFrame:
    return vectors.select("target_id", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("n2"))


@query(f"WITH {FULL_ROWS} SELECT target_id, round(sum(a * a), 6) AS n2 FROM f GROUP BY target_id")
def svd_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of the rows of U S where no rank is given: those of the matrix's rows."""
    rows, n, n_cols = full_rows(spark, sf_dir)
    found = svd.truncated_svd(rows, n, n_cols)
    return lengths(embed.embeddings(found, len(found.s), 1.0))


@query(f"WITH {FULL_ROWS} SELECT target_id, round(sum(a * a), 6) AS n2 FROM f GROUP BY target_id")
def pca_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of the scores of all components."""
    return lengths(svd.principal_components(*full_rows(spark, sf_dir))[0])


@query(
    f"""WITH {FULL_ROWS}, g AS (SELECT p.ctx_id AS i, q.ctx_id AS j, sum(p.a * q.a) AS val FROM f p JOIN f q ON p.target_id = q.target_id GROUP BY p.ctx_id, q.ctx_id)
SELECT round(sum(val) FILTER (i = j), 6) AS trace, round(sum(val * val), 4) AS squares FROM g"""
)
def symmetric_eigen_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of all eigenvalues of the products of columns, and of their squares."""
    rows, _, n_cols = full_rows(spark, sf_dir)
    products = svd.gram_rows(rows, n_cols)
    square = products.select(F.col("k").alias("target_id"), F.sequence(F.lit(0), F.size("vec") - 1).alias("idx"), F.col("vec").alias("val"))
    values, _ = svd.symmetric_eigen(durable(square, "square"), n_cols)
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 4))], "trace double, squares double")


@query(f"WITH {HELLINGER} SELECT count(DISTINCT target_id) * {RANK} AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS sd FROM m")
def gaussian_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and deviation, to one decimal, of the random numbers that a projection draws for the rows."""
    rows = sparse_rows(spark, sf_dir)[1].select("target_id").mapInPandas(lambda batches: (_moments(b["target_id"].to_numpy()) for b in batches), "n long, s double, q double")
    sums = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("n", (F.round(mean, 1) + 0.0).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - mean * mean), 1).alias("sd"))


def _moments(ids):
    import pandas as pd

    x = svd.gaussian_rows(ids, RANK)
    return pd.DataFrame({"n": [x.size], "s": [x.sum()], "q": [(x * x).sum()]})


@query(f"WITH {COOC} SELECT word_id, word, {DIM} AS dim, 1.0::DOUBLE AS norm FROM target WHERE word_id IN (SELECT target_id FROM cooc)")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every found target has a vector of the asked length, and of length one."""
    c = counted(spark, sf_dir)
    found = embed.embeddings(pipeline.decompose(c, options()), DIM, 0.5, normalize=True)
    named = embed.named(cooc.found_targets(c.cooc, c.targets), found)
    return named.select("word_id", "word", F.size("vec").alias("dim"), F.round(F.sqrt(V.dot(F.col("vec"), F.col("vec"))), 6).alias("norm"))


@query(f"WITH {HELLINGER} SELECT DISTINCT target_id, 0.0::DOUBLE AS away FROM m")
def fold_in_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding in the rows that were decomposed gives their own vectors."""
    c, rows, n_cols = sparse_rows(spark, sf_dir)
    n = rows.count()
    found = svd.truncated_svd(rows, n, n_cols, min(RANK, n, n_cols))
    again = embed.fold_in(rows, found, DIM, 0.5).withColumnRenamed("vec", "again")
    away = F.zip_with("again", "vec", lambda a, b: a - b)
    return embed.embeddings(found, DIM, 0.5).join(again, "target_id").select("target_id", (F.round(F.sqrt(V.dot(away, away)), 6) + 0.0).alias("away"))


#: Targets of conversations over the contexts of documents: those that are folded in.
INFERRED = f"""{BAND}, {sql_tokens('turn', '(SELECT conv_id, turn AS turn_no, text FROM conversations)', 'conv_id', 'turn_no')},
other AS (SELECT word, (row_number() OVER (ORDER BY freq DESC, word) - 1)::INTEGER AS word_id, freq FROM (SELECT word, count(*) AS freq FROM turn GROUP BY word)),
pair AS (SELECT DISTINCT o.word_id, o.word FROM turn a JOIN turn b ON a.doc_id = b.doc_id AND a.turn_no = b.turn_no AND a.line_no = b.line_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {WINDOW}
  JOIN other o ON o.word = a.word AND o.freq >= {MIN_FREQ} JOIN ctx c ON c.word = b.word)"""


@query(f"WITH {INFERRED} SELECT word_id, word, {DIM} AS dim FROM pair")
def svd_inference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of conversations get a vector."""
    return svd_inference(spark, sf_dir).select("word_id", "word", F.size("vec").alias("dim"))


# --- given vectors -----------------------------------------------------------------------------

E64 = "embedding::DOUBLE[]"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


@query(f"SELECT vec_id, list_transform({E64}, lambda x: round(x / sqrt(list_dot_product({E64}, {E64})), 6)) AS vec FROM embeddings")
def emb_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.transform(V.unit(F.col("vec")), lambda x: V.rounded(x, 6)).alias("vec"))


@query(f"SELECT vec_id, list_transform(({E64})[1:16], lambda x: round(x, 6)) AS vec FROM embeddings")
def emb_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.transform(V.truncate(F.col("vec"), 16), lambda x: V.rounded(x, 6)).alias("vec"))


@query(f"SELECT vec_id, list_transform(range(1, 17), lambda i: round(({E64})[i] * sqrt(17 - i), 6)) AS vec FROM embeddings")
def emb_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component i of 16 times the square root of a falling singular value 16, 15, ..., 1."""
    import numpy as np

    found = embed.scale(vectors(spark, sf_dir).select("vec_id", "vec"), embed.weights(np.arange(16, 0, -1.0), 0.5), 16)
    return found.select("vec_id", F.transform("vec", lambda x: V.rounded(x, 6)).alias("vec"))


KNN = f"""d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
  round(list_sum(list_transform(list_zip(q.{E64}, v.{E64}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d2
  FROM embeddings q JOIN embeddings v ON q.vec_id % 25 = 0 AND q.vec_id <> v.vec_id),
knn AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id))::INTEGER AS rank, neighbor_id, d2 FROM d
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) <= 10)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every 25th id."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select("vec_id")


@query(f"WITH {KNN} SELECT query_id, rank, neighbor_id, round(d2, 6) AS d2 FROM knn")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(table(spark, sf_dir, "embeddings"), asked(spark, sf_dir)).withColumn("d2", F.round("d2", 6))


@query(f"WITH {KNN} SELECT 'w' || query_id AS word, 'w' || query_id || ' --> ' || string_agg('w' || neighbor_id, ', ' ORDER BY rank) AS line FROM knn GROUP BY query_id")
def knn_list_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    names = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), F.col("vec_id")).alias("word"))
    listed = asked(spark, sf_dir).select(F.concat(F.lit("w"), F.col("vec_id")).alias("word"))
    unknown = spark.createDataFrame([("nobody",)], "word string")
    return neighbors.listed(e, names, listed.union(unknown)).select("word", F.col("line").alias("line"))


#: Pairs of each vector with the one of seven times its id, in five sets; the gold value is a number made from the ids, with ties.
PAIRS = f"""n AS (SELECT count(*) AS n FROM embeddings),
pair AS (SELECT 'set' || (a.vec_id % 5) AS dataset, a.vec_id AS w1, b.vec_id AS w2, ((a.vec_id * 13 + b.vec_id) % 11)::DOUBLE AS gold,
  list_dot_product(a.{E64}, b.{E64}) / sqrt(list_dot_product(a.{E64}, a.{E64}) * list_dot_product(b.{E64}, b.{E64})) AS raw
  FROM embeddings a, n JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % n),
scored AS (SELECT dataset, w1, w2, gold, round(raw, 9) AS score FROM pair)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("word"), "vec")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    a, b = F.col("vec_id"), (F.col("vec_id") * 7 + 1) % n
    pairs = e.select(F.concat(F.lit("set"), a % 5).alias("dataset"), a.alias("w1"), b.alias("w2"), ((a * 13 + b) % 11).cast("double").alias("gold"))
    return evaluate.pair_scores(named(spark, sf_dir), pairs).withColumn("score", F.round("score", 9))


@query(f"WITH {PAIRS} SELECT dataset, w1, w2, gold, round(score, 6) AS score FROM scored")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS} SELECT dataset, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM scored GROUP BY dataset")
def pair_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.moments(scored(spark, sf_dir), "dataset").select("dataset", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {PAIRS} SELECT dataset, round(corr(score, gold), 6) AS pearson FROM scored GROUP BY dataset")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pearson(scored(spark, sf_dir)).withColumn("pearson", F.round("pearson", 6))


RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY gold DESC) - 1 + (count(*) OVER (PARTITION BY dataset, gold) - 1) / 2 AS r2,
  rank() OVER (PARTITION BY dataset ORDER BY score DESC) - 1 + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2 AS r1 FROM scored)"""


@query(f"WITH {PAIRS}, {RANKS} SELECT dataset, w1, gold, r2 AS place FROM ranked")
def avg_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_ranks(scored(spark, sf_dir), "gold", "place", "dataset").select("dataset", "w1", "gold", "place")


@query(f"WITH {PAIRS}, {RANKS} SELECT dataset, round(1 - 6 * sum((r1 - r2) ** 2) / (count(*) * (count(*) * count(*) - 1.0)), 6) AS spearman FROM ranked GROUP BY dataset")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spearman(scored(spark, sf_dir)).withColumn("spearman", F.round("spearman", 6))


@query(f"WITH {PAIRS} SELECT dataset, w1, w2, (row_number() OVER (ORDER BY score DESC, w1) - 1)::INTEGER AS place FROM scored")
def argsort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.argsort(scored(spark, sf_dir), "score", ascending=False, tie="w1").select("dataset", "w1", "w2", F.col("place").cast("int").alias("place"))


@query(
    f"""WITH {PAIRS}, {RANKS} SELECT dataset, count(*) AS n_pairs, count(*) AS n_found, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd,
round(corr(score, gold), 6) AS pearson, round(1 - 6 * sum((r1 - r2) ** 2) / (count(*) * (count(*) * count(*) - 1.0)), 6) AS spearman FROM ranked GROUP BY dataset"""
)
def similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = scored(spark, sf_dir).select("dataset", "w1", "w2", "gold")
    found = evaluate.similarity_report(named(spark, sf_dir), known)
    return found.select("dataset", "n_pairs", "n_found", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "pearson", "spearman")])


#: The same pairs, and for each dataset some with a word that has no vector.
@query(
    f"""WITH {PAIRS}, p AS (SELECT dataset, count(*) AS n FROM pair GROUP BY dataset)
SELECT dataset, 2 * n AS n_pairs, n AS n_found FROM p WHERE dataset IN ('set0', 'set3')"""
)
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir)
    known = found.select("dataset", "w1", "w2", "gold")
    pairs = known.union(known.select("dataset", -F.col("w1") - 1, "w2", "gold"))
    pairs = evaluate.choose(pairs, "dataset", set0=True, set1=False, set3=True)
    return evaluate.coverage(pairs, evaluate.pair_scores(named(spark, sf_dir), pairs))


#: Questions of four neighbouring ids, in categories by label; some name an id that doesn't exist.
QUESTIONS = """question AS (SELECT 'label' || label AS category, vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c, vec_id + 3 AS d FROM embeddings WHERE vec_id % 4 = 0),
answerable AS (SELECT q.* FROM question q WHERE a IN (SELECT vec_id FROM embeddings) AND b IN (SELECT vec_id FROM embeddings)
  AND c IN (SELECT vec_id FROM embeddings) AND d IN (SELECT vec_id FROM embeddings)),
candidate AS (SELECT DISTINCT category, unnest([a, b, c, d]) AS word FROM answerable),
unit AS (SELECT vec_id AS word, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
aim AS (SELECT q.*, list_transform(list_zip(ua.v, ub.v, uc.v), lambda z: z[2] - z[1] + z[3]) AS aim
  FROM answerable q JOIN unit ua ON ua.word = a JOIN unit ub ON ub.word = b JOIN unit uc ON uc.word = c),
hit AS (SELECT aim.category, a, b, c, d, w.word, round(list_dot_product(u.v, aim), 12) AS score
  FROM aim JOIN candidate w ON w.category = aim.category AND w.word NOT IN (a, b, c) JOIN unit u ON u.word = w.word),
best AS (SELECT category, a, b, c, d, word AS guess FROM hit WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY category, a, b, c, d ORDER BY score DESC, word) = 1),
answered AS (SELECT q.*, guess, coalesce(guess = q.d, false) AS correct FROM answerable q LEFT JOIN best USING (category, a, b, c, d)),
accuracy AS (SELECT q.category, count(*) AS n_questions, coalesce(any_value(n_answered), 0) AS n_answered, coalesce(any_value(accuracy), 0) AS accuracy
  FROM question q LEFT JOIN (SELECT category, count(*) AS n_answered, avg(correct::INTEGER) AS accuracy FROM answered GROUP BY category) s ON s.category = q.category GROUP BY q.category)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0")
    return e.select(F.concat(F.lit("label"), F.col("label")).alias("category"), a.alias("a"), (a + 1).alias("b"), (a + 2).alias("c"), (a + 3).alias("d"))


@query(f"WITH {QUESTIONS} SELECT category, a, b, c, d, guess, correct FROM answered")
def analogy_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.analogies(named(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {QUESTIONS} SELECT category, word FROM candidate")
def analogy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidates(evaluate.answerable(named(spark, sf_dir), questions(spark, sf_dir)))


@query(f"WITH {QUESTIONS} SELECT category, n_questions, n_answered, round(accuracy, 6) AS accuracy FROM accuracy")
def analogy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    found = evaluate.accuracies(q, evaluate.analogies(named(spark, sf_dir), q))
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {QUESTIONS} SELECT round(sum(accuracy) / 10, 6) AS macro FROM accuracy")
def analogy_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    found = evaluate.macro_average(evaluate.accuracies(q, evaluate.analogies(named(spark, sf_dir), q)), 10)
    return found.withColumn("macro", F.round("macro", 6))


# --- interchange -------------------------------------------------------------------------------


@query(f"SELECT vec_id, array_to_string(list_transform({E64}, lambda x: printf('%+f ', x)), '') AS line FROM embeddings")
def matrix_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", io.vector_text(F.col("vec")).alias("line"))


@query(f"SELECT vec_id, list_transform({E64}, lambda x: round(x, 5)) AS vec FROM embeddings")
def libsvm_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as "id:value" text and parsed again."""
    v = vectors(spark, sf_dir)
    line = io.sparse_text(F.sequence(F.lit(0), F.size("vec") - 1), F.transform("vec", lambda x: V.rounded(x, 5)))
    parsed = v.select("vec_id", io.parse_sparse(line).alias("e"))
    return parsed.select("vec_id", F.transform("e", lambda x: V.rounded(x["val"], 5)).alias("vec"))


@query(f"WITH {VOCAB} SELECT word || ' ' || freq AS line FROM vocab")
def vocab_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.vocab_lines(words(spark, sf_dir))


@query(f"WITH {COOC} SELECT target_id, ctx_id, val FROM cooc")
def cooc_records_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrences packed to 12-byte records and read again."""
    return io.unpack_records(durable(io.pack_records(counted(spark, sf_dir).cooc), "records"))


MANIFEST = ", ".join(f"('{k}', '{v}')" for k, v in asdict(options()).items())


@query(f"SELECT * FROM (VALUES {MANIFEST}) t(key, value)")
def options_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options, written as key=value lines and read again."""
    path = shared_path(spark, "options")
    io.write_options(pipeline.manifest(spark, options()), path)
    return io.read_options(spark, path)


@query(f"WITH {VOCAB} SELECT word, freq, word_id FROM vocab")
def vocab_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "vocab-file")
    io.write_lines(io.vocab_lines(words(spark, sf_dir)), path)
    return io.read_vocab(spark, path)


@query(f"WITH {BAND} SELECT ctx_id AS id, word FROM ctx")
def word_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "words-file")
    io.write_words(vocab.context_band(durable(ranked(spark, sf_dir), "vocab"), UPPER, LOWER), path, "ctx_id")
    return io.read_words(spark, path)


@query(f"WITH v AS (SELECT {E64} AS e, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_id FROM embeddings) SELECT row_id, list_transform(e[1:16], lambda x: round(x, 5)) AS vec FROM v")
def matrix_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text matrix, and its first columns."""
    path = shared_path(spark, "matrix-file")
    io.write_matrix(vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: V.rounded(x, 5))), path, "vec_id")
    return io.read_matrix(spark, path, 16).select("row_id", F.transform("vec", lambda x: V.rounded(x, 5)).alias("vec"))


@query(f"WITH v AS (SELECT {E64} AS e, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS target_id FROM embeddings) SELECT target_id, list_transform(e, lambda x: round(x, 5)) AS val, 64 AS width FROM v")
def sparse_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sparse-file")
    line = io.sparse_text(F.sequence(F.lit(0), F.size("vec") - 1), F.transform("vec", lambda x: V.rounded(x, 5)))
    io.write_lines(vectors(spark, sf_dir).orderBy("vec_id").select(line.alias("line")), path)
    rows, width = io.read_sparse(spark, path)
    return rows.select("target_id", F.transform("val", lambda x: V.rounded(x, 5)).alias("val"), F.lit(width).alias("width"))


@query(f"WITH {HELLINGER} SELECT DISTINCT target_id, 0.0::DOUBLE AS away, {RANK} AS rank FROM m")
def svd_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decomposition, written and read; U against A V / S of what was read."""
    _, rows, n_cols = sparse_rows(spark, sf_dir)
    n = rows.count()
    path = shared_path(spark, "svd")
    io.write_svd(svd.truncated_svd(rows, n, n_cols, min(RANK, n, n_cols)), path)
    found = io.read_svd(spark, path)
    again = svd.project(rows, found.v / found.s).withColumnRenamed("vec", "again")
    away = F.zip_with("again", "vec", lambda a, b: a - b)
    return found.u.join(again, "target_id").select("target_id", (F.round(F.sqrt(V.dot(away, away)), 6) + 0.0).alias("away"), F.lit(len(found.s)).alias("rank"))


@query("WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents) SELECT line, count(*) AS n FROM l GROUP BY line")
def gzip_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the documents, through gzipped text files."""
    path = shared_path(spark, "gzip")
    text = documents(spark, sf_dir).select(F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line"))
    io.write_lines(text, path, gzip=True)
    return io.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT dataset, 'w' || w1 AS w1, 'w' || w2 AS w2, gold FROM pair WHERE dataset = 'set1'")
def pairs_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set as tab-separated lines that end with CR LF."""
    path = shared_path(spark, "pairs")
    known = scored(spark, sf_dir).where("dataset = 'set1'")
    io.write_lines(known.select(F.concat(F.lit("w"), "w1", F.lit("\tw"), "w2", F.lit("\t"), "gold", F.lit("\r")).alias("line")), path)
    return io.read_pairs(spark, path, "set1")


@query(f"WITH {QUESTIONS} SELECT category, 'w' || a AS a, 'w' || b AS b, 'w' || c AS c, 'w' || d AS d FROM question WHERE category = 'label3'")
def questions_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "questions")
    known = questions(spark, sf_dir).where("category = 'label3'")
    io.write_lines(known.select(F.concat_ws(" ", *[F.concat(F.lit("w"), c) for c in "abcd"]).alias("line")), path)
    return io.read_questions(spark, path, "label3")
