"""The pipeline's near-duplicate stage proposes pairs by pivot distance tables, and loses none."""

import numpy as np

from lexiloom.llm import near_copies


def clusters(rng, n, copies, flips):
    """n fingerprints, and copies of each with some bits flipped, in mixed order."""
    bits = np.repeat(rng.integers(0, 2, (n, near_copies.BITS), np.uint8), copies, axis=0)
    for row in bits:
        row[rng.choice(near_copies.BITS, flips, replace=False)] ^= 1
    return np.packbits(rng.permutation(bits), axis=1, bitorder="little").view(np.uint64)


def parts_of(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[a] if x == label[b] else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in label}


def test_same_links_as_all_pairs():
    rng = np.random.default_rng(4)
    fps = np.concatenate([clusters(rng, 7, 5, f) for f in (0, 10, 28, 34)])
    bucket = np.sort(rng.integers(0, 6, len(fps))) * 3
    for side in (np.zeros(len(fps), np.int8), rng.integers(1, 3, len(fps)).astype(np.int8)):
        got = near_copies.near_fingerprints(bucket, fps, side, 64)
        ok = lambda i, j: bucket[i] == bucket[j] and (side[i] == 0 or side[i] != side[j]) and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 64
        want = [(i, j) for j in range(len(fps)) for i in range(j) if ok(i, j)]
        assert want and all(ok(i, j) for i, j in got)
        assert parts_of(len(fps), got) == parts_of(len(fps), want)
    none = np.zeros(0, np.int64)
    assert near_copies.near_fingerprints(none, np.zeros((0, 4), np.uint64), none, 64) == []


def test_the_table_discards_pairs():
    rng = np.random.default_rng(6)
    fps = clusters(rng, 8, 40, 8)
    seen = near_copies.pivot_distances(np.zeros(len(fps), np.int64), fps)
    i, j = np.triu_indices(len(fps), 1)
    near = near_copies.apart(fps[i], fps[j]) <= 64
    a, b = near_copies.possible(seen, i, j, 64)
    left = set(zip(a.tolist(), b.tolist(), strict=True))
    assert set(zip(i[near].tolist(), j[near].tolist(), strict=True)) <= left
    assert len(left) - near.sum() < 0.2 * (~near).sum()
