import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluate, neighbors
from lexiloom.sources import interchange as io


def scores(spark, pairs):
    return spark.createDataFrame([("s", float(a), float(b)) for a, b in pairs], "dataset string, score double, gold double")


def ranks(values):
    return [sum(v > x for v in values) + (sum(v == x for v in values) - 1) / 2 for x in values]


def test_correlations_with_ties(spark):
    pairs = [(1, 3), (2, 3), (2, 1), (5, 9), (0, 2)]
    df = scores(spark, pairs)
    a, b = zip(*pairs, strict=True)
    n = len(pairs)
    want = 1 - 6 * sum((x - y) ** 2 for x, y in zip(ranks(a), ranks(b), strict=True)) / (n * (n * n - 1))
    assert evaluate.spearman(df).first().spearman == pytest.approx(want)
    assert evaluate.pearson(df).first().pearson == pytest.approx(np.corrcoef(a, b)[0, 1])
    m = evaluate.moments(df, "dataset").first()
    assert (m.mean, m.sd) == (pytest.approx(np.mean(a)), pytest.approx(np.std(a, ddof=1)))


def test_one_pair_has_no_correlation(spark):
    df = scores(spark, [(1, 2)])
    assert evaluate.spearman(df).first().spearman is None and evaluate.pearson(df).first().pearson is None


def words(spark, vectors):
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vectors.items()], "word string, vec array<double>")


def asked(spark, rows):
    return spark.createDataFrame(rows, "category string, a string, b string, c string, d string")


def test_unknown_words_are_dropped(spark):
    v = words(spark, {"a": [1, 0], "b": [1, 1], "z": [0, 0]})
    pairs = spark.createDataFrame([("s", "A", "b", 1.0), ("s", "a", "x", 1.0), ("s", "a", "z", 1.0)], "dataset string, w1 string, w2 string, gold double")
    got = {(r.w1, r.w2): r.score for r in evaluate.pair_scores(v, pairs, lower=True).collect()}
    assert got == {("a", "b"): pytest.approx(0.5**0.5), ("a", "z"): None}
    assert tuple(evaluate.coverage(pairs, evaluate.pair_scores(v, pairs)).first()) == ("s", 3, 1)


def test_analogies(spark):
    v = words(spark, {"man": [1, 0, 0.2], "king": [1, 1, 0.2], "woman": [0, 0, 1], "queen": [0, 1, 1], "far": [-1, -1, -1]})
    q = asked(spark, [("x", "man", "king", "woman", "queen"), ("x", "man", "king", "woman", "queen"), ("y", "man", "none", "woman", "queen")])
    got = evaluate.analogies(v, q)
    assert [r.guess for r in got.collect()] == ["queen", "queen"]
    acc = {r.category: (r.n_questions, r.n_answered, r.accuracy) for r in evaluate.accuracies(q, got).collect()}
    assert acc == {"x": (2, 2, 1.0), "y": (1, 0, 0.0)}
    assert evaluate.macro_average(evaluate.accuracies(q, got), 4).first().macro == 0.25


def test_no_positive_score_is_wrong(spark):
    v = words(spark, {"a": [1, 0], "b": [0, 1], "c": [-1, 1], "d": [2, -3]})
    got = evaluate.analogies(v, asked(spark, [("x", "a", "b", "c", "d")])).first()
    assert got.guess is None and got.correct is False


def test_neighbours(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.select("vec_id").where("vec_id in (0, 3)")
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in neighbors.nearest(v, q, top=3).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 4, (3, 1): 2, (3, 2): 4, (3, 3): 0}
    assert neighbors.nearest(v, q, top=99).count() == 8  # all others, not more
    assert neighbors.nearest(v, q.limit(0)).count() == 0
    names = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), F.col("vec_id")).alias("word"))
    listed = spark.createDataFrame([("w0",), ("W3",)], "word string")
    assert [r.line for r in neighbors.listed(v, names, listed, 2).collect()] == ["w0 --> w1, w2"]
    assert neighbors.sample_words(names, 2, 7).collect() == neighbors.sample_words(names, 2, 7).collect()


def test_records(spark):
    rows = [(2, 1, 0.5), (0, 7, 3.0), (0, 2, 1.0)]
    df = spark.createDataFrame(rows, "target_id int, ctx_id int, val double")
    blobs = io.pack_records(df)
    assert b"".join(bytes(r.payload) for r in blobs.orderBy("seq").collect()) == b"".join(io.record(*r) for r in sorted(rows))
    assert sorted(map(tuple, io.unpack_records(blobs).collect())) == sorted(rows)


def test_text_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 10\nof 5\nand 5\n")
    assert [tuple(r) for r in io.read_vocab(spark, str(tmp_path / "v.txt")).orderBy("word_id").collect()] == [("the", 10, 0), ("of", 5, 1), ("and", 5, 2)]
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("a b\n\nlast without newline")
    assert [r.text for r in io.read_corpus(spark, str(tmp_path / "c.txt.gz"), 2).orderBy("doc_id").collect()] == ["a b", "", "last without newline"]
    assert io.is_gzip((tmp_path / "c.txt.gz").read_bytes()) and not io.is_gzip(b"plain")
    (tmp_path / "p.txt").write_bytes(b"a\tb\t1.5\r\nbad\r\n")
    assert [tuple(r) for r in io.read_pairs(spark, str(tmp_path / "p.txt"), "s").collect()] == [("s", "a", "b", 1.5)]
    (tmp_path / "q.txt").write_text("a b c d\nx\n")
    assert [tuple(r) for r in io.read_questions(spark, str(tmp_path / "q.txt"), "k").collect()] == [("k", "a", "b", "c", "d")]
    assert io.count_lines(spark, str(tmp_path / "v.txt")) == 3 and io.count_columns(spark, str(tmp_path / "v.txt")) == 2


def test_matrix_text(spark, tmp_path):
    m = spark.createDataFrame([(1, [0.5, -2.0]), (0, [1.0, 0.25])], "row_id long, vec array<double>")
    io.write_matrix(m, str(tmp_path / "m"))
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "m")).collect()] == ["+1.000000 +0.250000 ", "+0.500000 -2.000000 "]
    assert [tuple(r) for r in io.read_matrix(spark, str(tmp_path / "m"), 1).orderBy("row_id").collect()] == [(0, [1.0]), (1, [0.5])]
    assert not io.ragged(m)


def test_sparse_text(spark):
    line = spark.createDataFrame([("5:1.5 0:2 5:0.5 junk",)], "t string").select(io.parse_sparse(F.col("t")).alias("e")).first().e
    assert [tuple(x) for x in line] == [(0, 2.0), (5, 0.5)]


def test_options(spark):
    assert [tuple(r) for r in io.options_table(spark, {"b": 1, "a": "x"}).collect()] == [("a", "x"), ("b", "1")]
