import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import vocab


def lines_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r.doc_id, r.line_no): r.toks for r in T.corpus(df, **options).collect()}


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "clean"), [("Foo 1,234.5.", "foo 0"), ("a1b2", "a0b0"), (".5", ".0"), ("1-2", "0-0"), ("É", "É"), ("", ""), (None, None)])
def test_preprocess(spark, raw, clean):
    assert value(spark, raw, T.preprocess) == clean


def test_switches(spark):
    assert value(spark, "A1", lambda c: T.preprocess(c, lower=False)) == "A0"
    assert value(spark, "A1", lambda c: T.preprocess(c, digit=False)) == "a1"


def test_tokens(spark):
    got = lines_of(spark, ["a\rb\t\t c \n\nlast", "x" * 150, None, ""])
    assert got == {(0, 0): ["ab", "c"], (0, 1): [], (0, 2): ["last"], (1, 0): ["x" * 98], (3, 0): []}


def test_long_token_keeps_whole_characters(spark):
    assert lines_of(spark, ["é" * 60 + "x"])[0, 0] == ["é" * 49]
    assert lines_of(spark, ["a" + "é" * 60])[0, 0] == ["a" + "é" * 48]


def test_fields_and_conversions(spark):
    assert value(spark, "a,b,c", lambda c: T.field(c, 1)) == "b"
    assert value(spark, "a,b,c", lambda c: T.field(c, 5)) is None
    assert value(spark, "a-b-", lambda c: T.remove_all(c, "-")) == "ab"
    assert value(spark, "--a-", lambda c: T.strip_leading(c, "-")) == "a-"
    assert value(spark, "1.5\r", lambda c: T.parse(c, "double")) == 1.5
    assert value(spark, "1.5x", lambda c: T.parse(c, "double")) is None
    assert value(spark, "x1", T.has_digit) is True


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, freq long")


def test_ids_are_ranks(spark):
    counts = {"b": 5, "a": 5, "zz": 9, "é": 1, "e": 1, "ea": 1, "": 2}
    got = {r.word: r.word_id for r in vocab.with_ids(table(spark, counts)).collect()}
    want = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    assert got == {w: i for i, w in enumerate(want)}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_counts_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(50)], "doc_id long, text string").repartition(parts)
    got = {r.word: r.freq for r in vocab.counts(T.corpus(df, digit=False)).collect()}
    assert sum(got.values()) == 100 and got["w0"] == 8 + 17


def test_occurrences_when_all_are_frequent(spark):
    got = {r.threshold: r.n_types for r in vocab.occurrence_thresholds(table(spark, {"a": 5, "b": 3}), (5, 3, 2)).collect()}
    assert got == {5: 1, 3: 2, 2: 2}


def test_probabilities(spark):
    got = {round(r.threshold, 3): r.n_types for r in vocab.probability_thresholds(table(spark, {"a": 90, "b": 9, "c": 1}), 3).collect()}
    assert got == {1.0: 0, 0.1: 1}  # c reaches 0.01 exactly, b too: no word falls under 0.01


def test_totals_of_nothing(spark):
    assert tuple(vocab.totals(table(spark, {"a": 1}).limit(0)).first()) == (0, 0)


def test_band(spark):
    v = vocab.with_ids(table(spark, {"a": 60, "b": 20, "c": 10, "d": 10}))
    ids = lambda df: [(r.word, r.ctx_id) for r in df.orderBy("ctx_id").collect()]
    assert ids(vocab.context_band(v, 0.5, 0.2)) == [("b", 0)]
    assert ids(vocab.context_band(v, 0.5, 0.2, inclusive_tail=True)) == [("b", 0), ("c", 1)]
    assert ids(vocab.context_band(v, 1.0, 0.1)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    with pytest.raises(ValueError):
        vocab.context_band(v, 0.1, 0.2)
    with pytest.raises(ValueError):
        vocab.targets(v, 0)


def test_context_list(spark):
    v = vocab.with_ids(table(spark, {"a": 60, "b": 20}))
    listed = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "id int, word string")
    assert {r.word: r.ctx_id for r in vocab.context_list(v, listed).collect()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        vocab.context_list(v, spark.createDataFrame([(0, "x")], "id int, word string"))


def test_running_counts(spark, tmp_path):
    from lexiloom.streaming.vocab import running_counts

    spark.createDataFrame([("A b",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = running_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {r.word: r.freq for r in spark.table("running").collect()} == {"a": 1, "b": 2}
    finally:
        q.stop()
