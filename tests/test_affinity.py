"""Products of stated rows with all rows: right at every block size, and without a shuffle of pairs."""

import numpy as np
import pytest

from lexiloom.operators import affinity, cooc
from lexiloom.plans import queries


def entries(spark, n, columns, seed=1, share=0.3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, columns)) < share, np.round(rng.random((n, columns)) + 0.1, 1), 0.0)
    x[5] = x[3]  # ties
    return x, spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero(), strict=True)], "target_id int, ctx_id int, a double")


def shuffled(spark, df):
    """Records that all stages of writing df put into shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def records():
        found = store.stageList(None, False, False, quantiles, jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = records()
    df.write.format("noop").mode("overwrite").save()
    return records() - before


def plain_top(x, queries, top):
    out = []
    for q in queries:
        p = x @ x[q]
        order = sorted((j for j in range(len(x)) if p[j] > 0), key=lambda j: (-round(p[j], 9), j))[:top]
        out += [(q, j, round(p[j], 6)) for j in order]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 3])
def test_most_alike(spark, monkeypatch, block):
    for name in ("ROWS", "QUERIES", "COLUMNS"):
        monkeypatch.setattr(affinity, name, block)
    monkeypatch.setattr(affinity, "ENTRIES", 20 if block == 3 else 1 << 21)
    x, m = entries(spark, 40, 7)
    got = affinity.most_alike(m, m.where("target_id % 5 = 0"), 4).collect()
    assert sorted((r.query_id, r.target_id, round(r.affinity, 6)) for r in got) == plain_top(x, range(0, 40, 5), 4)
    assert affinity.most_alike(m, m.limit(0)).collect() == []


def test_top_shuffles_no_pairs(spark):
    _, m = entries(spark, 300, 12, share=0.9)
    m = m.repartition(3).localCheckpoint()
    n = m.count()
    assert shuffled(spark, affinity.most_alike(m, m.where("target_id % 2 = 0"), 2)) < 2 * n + 300 * 2 * 4


@pytest.mark.parametrize("block", [512, 3])
def test_pairs(spark, monkeypatch, block):
    for name in ("ROWS", "QUERIES", "COLUMNS"):
        monkeypatch.setattr(affinity, name, block)
    x, m = entries(spark, 40, 7)
    asked = m.where("target_id % 5 = 0")
    pairs = [(q, j) for q in range(0, 40, 5) for j in range(40) if x[q] @ x[j] > 0]
    got = {(r.query_id, r.target_id): r.affinity for r in affinity.affinity(m, asked).collect()}
    assert got == {p: pytest.approx(x[p[0]] @ x[p[1]]) for p in pairs}
    got = {(r.query_id, r.target_id): r.d2 for r in affinity.squared_distances(m, asked).collect()}
    assert got == {(q, j): pytest.approx(((x[q] - x[j]) ** 2).sum(), abs=1e-12) for q, j in pairs}


def test_distances_shuffle_no_pairs(spark):
    _, m = entries(spark, 300, 12, share=0.9)
    m = m.repartition(3).localCheckpoint()
    assert shuffled(spark, affinity.squared_distances(m, m.where("target_id % 2 = 0"))) < 2 * m.count()


@pytest.mark.parametrize("size", [1 << 19, 3])
def test_counted_rows(spark, monkeypatch, size):
    monkeypatch.setattr(cooc, "TOKENS", size)
    monkeypatch.setattr(cooc, "HELD", 1 << 22 if size > 3 else 8)
    lines = [["a", "b", "x", "a", "a", "c"], [], ["b"], ["a", "b"] * 600, ["c", "x", "y", "a"]]
    corpus = spark.createDataFrame([(i, 0, toks) for i, toks in enumerate(lines)], "doc_id long, line_no int, toks array<string>").repartition(3, "doc_id")
    targets = spark.createDataFrame([("a", 0), ("b", 1), ("y", 70), ("gone", 9)], "word string, word_id int")
    contexts = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "word string, ctx_id int")
    want = {(r.target_id, r.ctx_id): r.val for r in cooc.cooccurrence(corpus, targets, contexts, 2).collect()}
    assert max(want.values()) > 255  # more than a byte holds
    rows = cooc.counted_rows(corpus, targets, contexts, 2)
    got = rows.collect()
    assert len({r.target_id for r in got}) == len(got) and all(r.idx == sorted(r.idx) for r in got)
    assert {(r.target_id, i): x for r in got for i, x in zip(r.idx, r.n, strict=True)} == want
    matrix = {(r.target_id, r.ctx_id): r.a for r in cooc.hellinger(cooc.cooccurrence(corpus, targets, contexts, 2)).collect()}
    assert {(r.target_id, i): x for r in cooc.hellinger_rows(rows).collect() for i, x in zip(r.idx, r.val, strict=True)} == matrix
    assert cooc.counted_rows(corpus, targets, contexts.limit(0), 2).collect() == []


def test_distance_query_shuffles_rows_not_entries(spark, sf_dir):
    """Its counts take fewer records than the words of the tasks and the entries of the matrix, one each."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def records():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    entries = queries.counted(spark, sf_dir).cooc.count()
    before = records()
    queries.words(spark, sf_dir).count()
    words = records() - before
    queries.hellinger_distance(spark, sf_dir).write.format("noop").mode("overwrite").save()
    n = records() - before - words
    print("records", n, "words", words, "entries", entries)
    assert n < 3 * words + entries


def test_distances_are_rounded_where_they_are_made(spark):
    _, m = entries(spark, 40, 7)
    got = affinity.squared_distances(m, m.where("target_id % 5 = 0"), digits=2)
    whole = affinity.squared_distances(m, m.where("target_id % 5 = 0"))
    assert sorted(got.collect()) == sorted((r.query_id, r.target_id, pytest.approx(r.d2, abs=0.0051)) for r in whole.collect())
    assert all(round(r.d2, 2) == r.d2 for r in got.collect())
