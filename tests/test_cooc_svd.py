import numpy as np
import pytest

from lexiloom.functions import text as T
from lexiloom.operators import cooc, embed, svd, vocab
from lexiloom.plans import pipeline


def counted(spark, texts, window, dynamic=False, contexts=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    toks = T.corpus(df)
    v = vocab.with_ids(vocab.counts(toks))
    c = vocab.context_band(v, 1.0, 0.0) if contexts is None else vocab.context_list(v, spark.createDataFrame(list(enumerate(contexts)), "id int, word string"))
    names = {r.word_id: r.word for r in v.collect()}
    ctx = {r.ctx_id: r.word for r in c.collect()}
    return {(names[r.target_id], ctx[r.ctx_id]): r.val for r in cooc.cooccurrence(toks, v, c, window, dynamic).collect()}


def brute(texts, window, dynamic=False):
    out = {}
    for t in texts:
        for line in t.split("\n"):
            w = line.split()
            for j in range(len(w)):
                for k in range(max(0, j - window), min(len(w), j + window + 1)):
                    if k != j:
                        out[w[j], w[k]] = out.get((w[j], w[k]), 0) + ((window + 1 - abs(j - k)) / window if dynamic else 1)
    return out


TEXTS = ["a b c\nd a a b", "c", "", "b d b e\n\nc a"]


@pytest.mark.parametrize("window", [1, 2, 5])
@pytest.mark.parametrize("dynamic", [False, True])
def test_window(spark, window, dynamic):
    got, want = counted(spark, TEXTS, window, dynamic), brute(TEXTS, window, dynamic)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(got[a, b] == pytest.approx(got[b, a]) for a, b in got)


@pytest.mark.parametrize("n", [63, 64, 65, 300])
def test_long_lines(spark, n):
    text = " ".join(f"w{chr(97 + i * i % 23)}" for i in range(n))
    assert counted(spark, [text], 5) == brute([text], 5)


def test_total_mass(spark):
    n, c = 9, 3
    got = counted(spark, [" ".join(f"w{chr(97 + i)}" for i in range(n))], c)
    assert sum(got.values()) == sum(min(n, j + c + 1) - max(0, j - c) - 1 for j in range(n))


def test_unknown_words_keep_their_place(spark):
    assert counted(spark, ["a x b"], 1, contexts=["a", "b"]) == {("x", "a"): 1, ("x", "b"): 1}


def test_listed_contexts(spark):
    assert counted(spark, ["a b c"], 2, contexts=["c"]) == {("a", "c"): 1, ("b", "c"): 1}


def test_hellinger_norm_and_single_row(spark):
    m = spark.createDataFrame([(0, 0, 3.0), (0, 2, 1.0), (5, 1, 7.0)], "target_id int, ctx_id int, val double")
    rows = {r.target_id: np.array(r.val) for r in cooc.csr(cooc.hellinger(m)).collect()}
    assert (rows[0] ** 2).sum() == pytest.approx(4 / 4.001) and (rows[5] ** 2).sum() == pytest.approx(7 / 7.001)
    assert tuple(cooc.shape(m).first()) == (2, 3, 3)


def matrix(spark, a):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "target_id int, idx array<int>, val array<double>")


def u_of(result):
    return np.array([r.vec for r in result.u.orderBy("target_id").collect()])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    a = rng.random((60, 25)) * (rng.random((60, 25)) < 0.4)
    a[7] = 0
    return a


@pytest.mark.parametrize("method", ["gram", "randomized"])
def test_svd(spark, sample, method):
    s = np.linalg.svd(sample, compute_uv=False)
    found = svd.truncated_svd(matrix(spark, sample), *sample.shape, 10, method, oversample=15, power_iters=4)
    assert np.allclose(found.s, s[:10], rtol=1e-6)
    u = u_of(found)
    assert np.allclose(u.T @ u, np.eye(10), atol=1e-6) and np.allclose(found.v.T @ found.v, np.eye(10), atol=1e-8)
    assert np.allclose(sample @ found.v, u * found.s, atol=1e-8)
    assert (found.v[np.abs(found.v).argmax(axis=0), range(10)] > 0).all()


def test_plain_randomized_is_not_above_exact(spark, sample):
    s = np.linalg.svd(sample, compute_uv=False)
    found = svd.truncated_svd(matrix(spark, sample), *sample.shape, 5, "randomized", oversample=0, power_iters=0)
    assert (found.s <= s[:5] + 1e-9).all()


def test_low_rank(spark):
    rng = np.random.default_rng(0)
    a = rng.random((50, 3)) @ rng.random((3, 20))
    assert len(svd.truncated_svd(matrix(spark, a), 50, 20, 8, "gram").s) >= 3
    found = svd.truncated_svd(matrix(spark, a), 50, 20, 3, "gram")
    assert np.allclose(found.s, np.linalg.svd(a, compute_uv=False)[:3])


def test_rank_is_checked(spark, sample):
    with pytest.raises(ValueError):
        svd.truncated_svd(matrix(spark, sample), 60, 25, 26)


def test_eigen_and_components(spark, sample):
    b = sample.T @ sample
    values, vectors = svd.symmetric_eigen(matrix(spark, b), 25, 25, method="gram")
    assert np.allclose(values, np.linalg.eigvalsh(b)[-len(values) :], atol=1e-6) and np.allclose(b @ vectors, vectors * values, atol=1e-6)
    scores, v = svd.principal_components(matrix(spark, sample), 60, 25, 4, method="gram")
    assert np.allclose([r.vec for r in scores.orderBy("target_id").collect()], sample @ v)


@pytest.mark.parametrize("eig", [0, 0.5, 1])
def test_folding_in_the_training_rows(spark, sample, eig):
    rows = matrix(spark, sample)
    found = svd.truncated_svd(rows, 60, 25, 8, "gram")
    a = embed.embeddings(found, 6, eig).orderBy("target_id").collect()
    b = embed.fold_in(rows, found, 6, eig).orderBy("target_id").collect()
    assert np.allclose([r.vec for r in a], [r.vec for r in b])


def test_weights():
    s = np.array([4.0, 1.0])
    assert embed.weights(s, 0.5).tolist() == [2, 1] and embed.weights(s, 0).tolist() == [1, 1] and embed.weights(s, 0.3, strict=False).tolist() == [4, 1]
    for bad in (0.3, 2):
        with pytest.raises(ValueError):
            embed.weights(s, bad)


def test_learn_and_infer(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + j)}" for j in rng.integers(0, 12, 30))) for i in range(20)], "doc_id long, text string")
    options = pipeline.Options(min_freq=1, lower_bound=1e-4, rank=5, dim=4)
    counts, found, vectors = pipeline.learn(docs, options)
    assert vectors.count() == counts.targets.count() == 12
    again = {r.word: r.vec for r in pipeline.infer(docs, counts.contexts, found, options).collect()}
    assert all(np.allclose(r.vec, again[r.word]) for r in vectors.collect())
    with pytest.raises(ValueError):
        pipeline.infer(docs, counts.contexts.limit(3), found, options)
    with pytest.raises(ValueError):
        pipeline.Options(dim=400)
    with pytest.raises(ValueError):
        pipeline.count(docs.limit(0), options)
