"""The steps one by one on files, what they refuse, and plans of large inputs."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import __main__ as shell
from lexiloom.operators import cooc, embed, evaluate, neighbors, svd
from lexiloom.plans import tools
from lexiloom.sources import interchange as io
from lexiloom.sources import tables

WORDS = [f"w{chr(97 + i)}" for i in range(14)]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """All steps, from a gzipped corpus."""
    home = tmp_path_factory.mktemp("steps")
    rng = np.random.default_rng(1)
    with gzip.open(home / "corpus.txt.gz", "wt") as f:
        f.write("\n".join(" ".join(rng.choice(WORDS, 30)).upper() + " 1,234" for _ in range(60)))
    run = lambda *a: shell.main([str(x) for x in a], spark)
    run("preprocess", "--input-file", home / "corpus.txt.gz", "--output-file", home / "clean", "--gzip", 1)
    run("vocab", "--input-file", home / "clean", "--vocab-file", home / "vocab")
    run("cooccurrence", "--input-file", home / "clean", "--vocab-file", home / "vocab", "--output-dir", home / "counts", "--min-freq", 2, "--lower-bound", 1e-4)
    run("pca", "--input-dir", home / "counts", "--rank", 6)
    run("embeddings", "--input-dir", home / "counts", "--output-name", home / "words", "--dim", 5, "--norm", 1)
    run("inference", "--cooc-dir", home / "counts", "--pca-dir", home / "counts/svd", "--output-name", home / "again", "--dim", 5, "--norm", 1)
    return home


def test_steps(spark, home):
    words = io.read_vocab(spark, f"{home}/vocab").collect()
    assert {r.word for r in words} == {*WORDS, "0"} and sum(r.freq for r in words) == 60 * 31
    assert [r.freq for r in sorted(words, key=lambda r: r.word_id)] == sorted((r.freq for r in words), reverse=True)
    stats = {(r.kind, r.threshold): r.n for r in tools.stats(spark, f"{home}/vocab").collect()}
    assert stats["types", None] == 15 and stats["tokens", None] == 1860 and stats["occurrences", 50.0] == sum(r.freq >= 50 for r in words)
    assert {r.word for r in io.read_words(spark, f"{home}/counts/target_words.txt").collect()} == {*WORDS, "0"}
    assert dict(map(tuple, io.read_options(spark, f"{home}/counts/options.txt").collect()))["MIN_FREQ"] == "2"
    a, b = ({r.word: r.vec for r in spark.read.parquet(f"{home}/{n}").collect()} for n in ("words", "again"))
    assert a.keys() == b.keys() == {*WORDS, "0"} and all(np.allclose(a[w], b[w], atol=1e-6) and np.isclose(np.dot(a[w], a[w]), 1) for w in a)


def test_evaluation_and_neighbors(spark, home, tmp_path):
    (tmp_path / "pairs").write_bytes(b"WA\twb\t3.5\r\nwc\twd\t1.0\r\nwa\tnobody\t2\r\nwe\twf\t2.5\r\n")
    (tmp_path / "questions").write_text("wa wb wc wd\nwa wb nobody wd\n")
    found = shell.main(["eval", "--word-file", f"{home}/words", "--pairs", f"mine={tmp_path}/pairs", "--questions", f"kin={tmp_path}/questions"], spark)
    rows = {r["kind"]: r for r in found.collect()}
    vec = {r.word: np.array(r.vec) for r in spark.read.parquet(f"{home}/words").collect()}
    scores = [vec[a] @ vec[b] for a, b in (("wa", "wb"), ("wc", "wd"), ("we", "wf"))]
    assert (rows["similarity"].n, rows["similarity"].n_found) == (4, 3) and rows["similarity"].pearson == pytest.approx(np.corrcoef(scores, [3.5, 1.0, 2.5])[0, 1])
    assert (rows["analogy"].name, rows["analogy"].n, rows["analogy"].n_found) == ("kin", 2, 1) and rows["macro"].accuracy == rows["analogy"].accuracy
    assert {r["kind"] for r in tools.evaluation(spark, f"{home}/words").collect()} == {"macro"}
    (tmp_path / "list").write_text("wa\nnobody\n")
    lines = {r.word: r.line for r in shell.main(["neighbors", "--word-file", f"{home}/words", "--list-file", f"{tmp_path}/list", "--top", "3"], spark).collect()}
    near = sorted((w for w in vec if w != "wa"), key=lambda w: ((vec["wa"] - vec[w]) ** 2).sum())[:3]
    assert lines == {"wa": f"wa --> {', '.join(near)}", "nobody": None}


def test_refused(spark, home, tmp_path):
    (tmp_path / "empty").write_text("")
    with pytest.raises(ValueError):
        tools.vocab(spark, str(tmp_path / "empty"))
    vectors = spark.read.parquet(f"{home}/words")
    with pytest.raises(ValueError):
        neighbors.listed(vectors.limit(3), vectors.select(F.col("word_id").alias("id"), "word"), vectors.select("word"), 2, "word_id", "vec")
    with pytest.raises(ValueError):
        embed.named(vectors.select("word_id", "word").limit(3), vectors.select(F.col("word_id").alias("target_id"), "vec"))
    for bad in (["pca"], ["vocab"], ["preprocess", "--input-file", "x", "--lower", "perhaps"]):
        with pytest.raises((SystemExit, Exception)):
            shell.main(bad, spark)


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf

        class sparkContext:
            master = "spark://somewhere:7077"

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            tables.shared_path(Elsewhere(), "x")


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(9)], "line string")
    io.write_lines(lines.coalesce(1), str(tmp_path / "z"), gzip=True)
    assert next((tmp_path / "z").glob("part*")).suffix == ".gz" and io.count_lines(spark, str(tmp_path / "z")) == 9
    (tmp_path / "t.txt").write_text("head er\n" + "\n".join(f"a{i} b" for i in range(5)))
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "t.txt"), header=True).collect()] == [f"a{i} b" for i in range(5)]
    assert io.count_lines(spark, str(tmp_path / "t.txt"), header=True) == 5 and io.size_of(spark, str(tmp_path / "t.txt")) == 32
    assert io.readable(spark, str(tmp_path / "t.txt")) and io.unique_name(spark, str(tmp_path / "t.txt")) == f"{tmp_path}/t.txt-1" and io.unique_name(spark, str(tmp_path / "u")) == f"{tmp_path}/u"
    assert io.is_gzip(next((tmp_path / "z").glob("part*")).read_bytes())
    (tmp_path / "r").write_bytes(b"".join(io.record(i, 2 * i, i / 4) for i in range(10)))
    assert sorted(map(tuple, io.read_records(spark, str(tmp_path / "r")).collect())) == [(i, 2 * i, i / 4) for i in range(10)]


def rows_of(spark, a):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "target_id int, idx array<int>, val array<double>")


def test_decompositions_on_disk(spark, tmp_path):
    a = np.random.default_rng(0).random((20, 8))
    found = svd.truncated_svd(rows_of(spark, a), 20, 8)
    io.write_svd(found, str(tmp_path / "svd"))
    back = io.read_svd(spark, str(tmp_path / "svd"))
    assert (back.s == found.s).all() and (back.v == found.v).all() and back.u.count() == 20 and len(found.s) == 8
    scores, v = svd.principal_components(rows_of(spark, a), 20, 8, 3)
    io.write_components(scores, v, str(tmp_path / "pca"))
    again, w = io.read_components(spark, str(tmp_path / "pca"))
    assert (w == v).all() and again.count() == 20
    values, vectors = svd.symmetric_eigen(rows_of(spark, a.T @ a), 8, 8)
    io.write_eigen(spark, values, vectors, str(tmp_path / "eigen"))
    assert all((x == y).all() for x, y in zip(io.read_eigen(spark, str(tmp_path / "eigen")), (values, vectors), strict=True))
    assert np.allclose(values, np.linalg.eigvalsh(a.T @ a))


@pytest.mark.parametrize("block", [8, 40, 10**6])
def test_blocks_of_columns_change_nothing(spark, monkeypatch, block):
    a = np.random.default_rng(1).random((30, 12)) * (np.random.default_rng(2).random((30, 12)) < 0.5)
    monkeypatch.setattr(svd, "BLOCK", block)
    rows = rows_of(spark, a)
    assert np.allclose(svd.gram(rows, 12), a.T @ a)
    found = svd.truncated_svd(rows, 30, 12, 4)
    assert np.allclose(found.s, np.linalg.svd(a, compute_uv=False)[:4], rtol=1e-4)
    assert np.allclose([r.vec for r in svd.project(rows, found.v).orderBy("target_id").collect()], a @ found.v)


def test_method_does_not_depend_on_size(spark):
    rows = rows_of(spark, np.eye(5))
    with pytest.raises(ValueError):
        svd.truncated_svd(rows, 5, 5, 2, "auto")
    with pytest.raises(ValueError):
        svd.gram(rows, svd.MAX_GRAM + 1)


@pytest.mark.parametrize("dynamic", [False, True])
def test_many_targets_are_joined_after_the_counting(spark, monkeypatch, dynamic):
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([([str(x) for x in rng.choice(WORDS, 40)],) for _ in range(30)], "toks array<string>")
    targets = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS[:9])], "word string, word_id int")
    contexts = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS[5:])], "word string, ctx_id int")
    few = sorted(map(tuple, cooc.cooccurrence(corpus, targets, contexts, 4, dynamic).collect()))
    monkeypatch.setattr(cooc, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, cooc.cooccurrence(corpus, targets, contexts, 4, dynamic).collect())) == few and len(few) == 81


def test_skewed_join_and_numbers(spark, monkeypatch):
    rows = spark.createDataFrame([(None if i % 17 == 0 else (7 if i % 3 else i % 50), i) for i in range(3000)], "k long, x long")
    found = rows.where("k is not null and k <> 3").groupBy("k").agg(F.max("x").alias("m"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(found.drop("n"), "k").select("k", "x", "m").collect()))
    for hot in (1 / 512, 1 / 3, 2.0):
        monkeypatch.setattr(tables, "HOT", hot)
        assert sorted(map(tuple, tables.skew_join(rows, found, "k", 3000).collect())) == want
    got = tables.numbered(rows, [F.desc_nulls_last("k"), F.col("x")], "place", {"before": "x"}).orderBy("place").collect()
    order = sorted(((r.k is None, -(r.k or 0), r.x) for r in rows.collect()))
    assert [r.place for r in got] == list(range(3000)) and [r.x for r in got] == [x for _, _, x in order]
    assert [r.before for r in got] == np.cumsum([0, *[x for _, _, x in order]])[:-1].tolist()
    assert tables.numbered(rows.limit(0), [F.col("x")], "place").collect() == []


def test_report_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in ("word string, vec array<double>", "dataset string, w1 string, w2 string, gold double", "category string, a string, b string, c string, d string")]
    rows = evaluate.report(*none).collect()
    assert len(rows) == 1 and rows[0].accuracy is None and rows[0].n == 0
