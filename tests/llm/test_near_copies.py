from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexiloom.llm import near_copies


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_classes(rows, similarity=0.8):
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]) >= similarity:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, r in zip(label, rows, strict=True):
        if r.doc_id is not None:
            least[x] = min(least.get(x, r.doc_id), r.doc_id)
    return Counter((r.doc_id, least.get(x)) for x, r in zip(label, rows, strict=True))


def edited(rng, n, similarity):
    """Two texts of n shingles whose sets are about so alike, as words at random places are replaced."""
    words = [f"w{i}" for i in rng.integers(0, 10**9, n + 4)]
    other, sets = list(words), shingles(" ".join(words))
    for at in rng.permutation(n + 4):
        changed = list(other)
        changed[at] = f"x{rng.integers(0, 10**9)}"
        if alike(sets, shingles(" ".join(changed))) < similarity:
            continue
        other = changed
    return " ".join(words), " ".join(other)


@pytest.mark.parametrize("tile", [4096, 8])
def test_same_as_brute_force(spark, odd, documents, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    both = documents.select("doc_id", "text").union(odd.select(odd["doc_id"] + 50_000, "text"))
    got = near_copies.classes(both).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == plain_classes(both.collect())
    assert near_copies.classes(odd.limit(0)).collect() == []


def test_recall_by_band(spark, sf_dir):
    rng = np.random.default_rng(3)
    rows, of = [], {}
    for band in (0.8, 0.85, 0.9, 0.95):
        for k in range(100):
            a, b = edited(rng, 200 if k % 2 else 40, band)
            of[len(rows)] = (band, alike(shingles(a), shingles(b)))
            rows += [(len(rows), a, "en", "s", 1), (len(rows) + 1, b, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    for band in (0.8, 0.85, 0.9, 0.95):
        pairs = [i for i, (x, _) in of.items() if x == band]
        assert all(of[i][1] >= band for i in pairs) and set(pairs) <= kept
        assert sum(i + 1 not in kept for i in pairs) >= 0.96 * len(pairs), band


def test_unrelated_short_texts_stay(spark, sf_dir):
    """Six-word texts whose 64-bit fingerprints are as near to an empty text's, or to each other, as the stage once linked."""
    from lexiloom.llm import simhash

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 6)) for _ in range(6000)]
    near = [t for t in texts if simhash.fingerprint(t, 5).bit_count() <= 6]
    assert len(near) >= 3
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["", None, *near, near[0].upper()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {0, *range(2, 2 + len(near))}
