import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexiloom.llm import multiprobe, order_minhash, simhash
from lexiloom.llm.components import components
from lexiloom.llm.words import word_hashes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    w = WORDS.findall(low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(rows, distance=4):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = [plain_fingerprint(r.text) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, fps[i], least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("parts", [1, 6])
def test_simhash(odd, documents, parts):
    both = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(parts)
    got = simhash.classes(both).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == plain_classes(both.collect())
    assert simhash.classes(odd.limit(0)).collect() == []


def clustered(n, seed, noise):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, noise), replace=False)) for c in rng.choice(centres, n)]
    return sorted({f - (1 << 64) if f >> 63 else f for f in fps})


@pytest.mark.parametrize(("distance", "tile"), [(4, 4096), (4, 40), (6, 64), (2, 40)])
def test_links_lose_nothing(spark, monkeypatch, distance, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = clustered(300, distance, 7) + [0, -1]
    edges = simhash.links(spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long"), distance)
    got = {r.node: r.root for r in components(edges).collect()}
    u = np.array(sorted(set(fps)), np.int64)
    near = np.bitwise_count(u[:, None].view(np.uint64) ^ u[None, :].view(np.uint64)) <= distance
    label = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert {int(u[i]): int(u[label[i]]) for i in range(len(u)) if near[i].sum() > 1} == got


def test_components_of_a_chain_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).collect() == []


def test_keep_one(odd, documents, spark):
    both = documents.union(documents.withColumn("doc_id", documents["doc_id"] + 100_000))
    kept = simhash.keep_one(both, distance=0)
    assert kept.columns == documents.columns
    texts = [r.text for r in kept.collect()]
    assert kept.agg({"doc_id": "max"}).first()[0] < 100_000 and len({plain_fingerprint(t, 5) for t in texts}) == len(texts)
    again = simhash.keep_one(odd, distance=0).collect()  # repeated and null ids
    assert Counter(plain_fingerprint(r.text, 5) for r in again) == Counter({plain_fingerprint(r.text, 5) for r in odd.collect()})


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from lexiloom.llm import words

    texts = [b"", b"  ", b"Alpha beta", b"b" * 700 + b" x", b"beta Alpha", b"\n"]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = word_hashes(data, bounds)
    monkeypatch.setattr(words, "PIECE", 5)
    assert all((a == b).all() for a, b in zip(whole, word_hashes(data, bounds), strict=True))
    assert whole[0][0] == whole[0][5] and whole[2].tolist() == [5, 4, 700, 1, 4, 5]
    assert len(set(whole[0].tolist())) == 4


def plain_near(a, b):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def test_order_minhash(odd, documents):
    both = documents.select("doc_id", "text").union(odd.select(odd["doc_id"] + 50_000, "text"))
    rows = sorted(both.where("doc_id is not null").collect(), key=lambda r: (r.doc_id, r.text or ""))
    got = order_minhash.fingerprint_with_next(both.where("doc_id is not null")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    found = {r.doc_id: r for r in got}
    once = {d for d, n in Counter(r.doc_id for r in rows).items() if n == 1}
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        if r.doc_id not in once:
            continue
        t, f = r.text or "", following.text or ""
        new = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        a, b, c = (order_minhash.signatures([x])[0] for x in (t, new, f))
        g = found[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex())
        assert (g.near_edited, g.near_next) == (pytest.approx(plain_near(a, b)), pytest.approx(plain_near(a, c)))


def test_order_matters():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    halves = words[200:] + words[:200]
    shuffled = [words[i] for i in rng.permutation(400)]
    a, b, c, d = order_minhash.signatures([" ".join(x) for x in (words, halves, shuffled, [*words[:390], *shuffled[:10]])])
    assert plain_near(a, a) == 1 and plain_near(a, c) < 0.05
    assert plain_near(a, d) > 0.8 > plain_near(a, b)  # the same k-mers in another order are less alike


def test_one_document_follows_itself(spark):
    r = order_minhash.fingerprint_with_next(spark.createDataFrame([(4, "abcdefgh ij")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert order_minhash.fingerprint_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nulls = spark.createDataFrame([(None, "a b"), (None, None), (3, "c")], "doc_id long, text string")
    assert len(order_minhash.fingerprint_with_next(nulls).collect()) == 3


def plain_nearest(rows, every=50, keep=5):
    good = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    out = {}
    for q, v in good:
        if q % every == 0:
            near = sorted((-float((v * x).sum() / np.sqrt((v * v).sum()) / np.sqrt((x * x).sum())), i) for i, x in good if i != q and len(x) == len(v))
            out[q] = [(i, -s) for s, i in near[:keep]]
    return out


def test_nearest_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain_nearest(rows.collect())
    got = {}
    for r in sorted(multiprobe.nearest(rows).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and got.keys() == want.keys()
    assert all(len(v) == 5 and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (100, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in multiprobe.nearest(df).collect()}
    want = plain_nearest([r for r in df.collect() if r.vec_id is not None])
    assert {k: v[0] for k, v in got.items()} == {(q, k + 1): i for q, v in want.items() for k, (i, _) in enumerate(v)}
    assert multiprobe.nearest(df.limit(0)).collect() == []


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "TILE_ROWS", 16)
    monkeypatch.setattr(multiprobe, "TILE_QUERIES", 2)
    rng = np.random.default_rng(0)
    vectors = [[1.0, 1.0, 0.0]] * 200 + rng.normal(size=(150, 3)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    began = time.time()
    got = {(r.query_id, r["rank"]): r.vec_id for r in multiprobe.nearest(df).collect()}
    want = plain_nearest(df.collect())
    assert [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    hits = sum(got.get((q, k + 1)) == i for q, v in want.items() for k, (i, _) in enumerate(v))
    assert hits >= 0.9 * sum(map(len, want.values())) and time.time() - began < 120


def test_probes_come_in_order_of_cost():
    k = 3
    sets = multiprobe.probe_sets(k, 20)
    assert sets[0] == () and len(set(sets)) == len(sets) == 20
    cost = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)] + [1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 2 * k)]
    costs = [sum(cost[j] for j in c) for c in sets]
    assert costs == pytest.approx(sorted(costs)) and cost == sorted(cost)
    inside = np.array([[0.2, 1.9, 1.0]])
    steps = multiprobe.steps_of(sets, inside)[0]
    assert not steps[0].any() and steps[1].tolist() == [-1, 0, 0] and steps[2].tolist() == [0, 0, -1]
    assert len({tuple(s) for s in steps.tolist()}) == len(steps)
    assert len(multiprobe.probe_sets(2, 100)) == 9  # all of them


def test_first_probe_is_the_one_that_meets():
    rng = np.random.default_rng(1)
    v = rng.normal(size=12)
    near = [v + rng.normal(size=12) * 0.2 for _ in range(60)]
    sets, hashes = multiprobe.probe_sets(8, 200), 8
    plan = multiprobe.Plan(hashes, 200, 1, "<f8")
    got = multiprobe.first_probes([(v, w) for w in near], hashes, sets)
    visited = [multiprobe.probed(multiprobe.unit_rows(v[None]), t, plan, sets)[0].tolist() for t in range(multiprobe.TABLES)]
    for w, g in zip(near, got.tolist(), strict=True):
        own = [int(multiprobe.cell_name(multiprobe.cells_of(multiprobe.unit_rows(w[None]), t, hashes)[0], 12, t)[0]) for t in range(multiprobe.TABLES)]
        assert g == min([c.index(o) for c, o in zip(visited, own, strict=True) if o in c], default=200)
    assert got.min() < 200


def test_ties_beyond_any_cut(spark, monkeypatch):
    """All of these are multiples of one vector, so every cosine is 1: the smallest ids are due."""
    monkeypatch.setattr(multiprobe, "HELD", 500)
    rows = [(i, [x * 2.0 ** (i % 60 - 30) for x in (1.0, 2.0, 3.0, 4.0 + i // 60 * 1e-3)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(multiprobe.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[100] == [60, 61, 62, 63, 64] and len(got) == 24


def clustered_vectors(n, dim=24, centres=60, seed=2, share=0.33):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    hot = rng.random(n) < share  # so many around one centre
    return c[np.where(hot, 0, rng.integers(0, centres, n))] + 0.15 * rng.normal(size=(n, dim))


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "TILE_ROWS", 50)
    monkeypatch.setattr(multiprobe, "TILE_QUERIES", 5)
    x = clustered_vectors(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plans = []
    fitted = multiprobe.fitted
    monkeypatch.setattr(multiprobe, "fitted", lambda *a: plans.append(fitted(*a)) or plans[-1])
    got = {}
    for r in multiprobe.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_nearest(df.collect())
    assert max(p[0] for p in plans[0].large.values()) > 1 and max(p[1] for p in plans[0].large.values()) > 1
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_most_pairs_of_clustered_vectors_are_not_compared():
    x = clustered_vectors(4000, share=0)
    unit, hashes = multiprobe.unit_rows(x), 12
    near = [(i, int(j)) for i in range(0, 4000, 50) for j in np.argsort(-(unit @ unit[i]))[1:6]]
    sets = multiprobe.probe_sets(hashes, multiprobe.MOST_PROBES)
    probes = int(np.sort(multiprobe.first_probes([(x[i], x[j]) for i, j in near], hashes, sets))[int(0.92 * len(near))]) + 1
    plan = multiprobe.Plan(hashes, probes, 1, "<f8")
    met = np.zeros((80, len(x)), bool)
    for t in range(multiprobe.TABLES):
        names = multiprobe.cell_name(multiprobe.cells_of(unit, t, hashes)[0], x.shape[1], t)
        for k, cells in enumerate(multiprobe.probed(unit[::50], t, plan, sets[:probes])):
            met[k] |= np.isin(names, cells)
    assert np.mean([met[i // 50, j] for i, j in near]) >= 0.9 and met.mean() < 0.2
