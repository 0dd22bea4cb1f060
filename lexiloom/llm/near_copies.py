"""Near copies: texts whose sets of word shingles are at least SIMILARITY alike, SimHash proposing and shingles deciding.

Equal shingle sets are one node, known by a 64-bit hash of the set. A node's fingerprint has
BITS bits, each the majority of the shingles' hash bits; a tie goes to the least hash, so that
bits of short texts are even too. At similarity J two fingerprints differ in about
BITS * acos(2J / (1 + J)) / pi bits: 39 of 256 at 0.8, 26 at 0.9.

Candidates: nodes that agree on all of some sample of bits share a bucket; there are as many
samples as give a pair that differs in the share REACH of its bits (more than pairs of 0.8 do
on the mean) a bucket in common with probability RECALL. As in simhash, a table holds each node's
Hamming distances to PIVOTS reference fingerprints, here nodes of its bucket, as random ones are all
equally far from unrelated texts; a pair whose distances to a pivot differ by more than DISTANCE is
discarded, and survivors within DISTANCE bits are joined. Unrelated texts are 8 standard deviations away from that.

Decision: every true pair that was met lies in one group of joined nodes, so each group is
compared by exact shingle sets, and only pairs of SIMILARITY or more link. Large buckets and
groups are dealt out as pairs of chunks; each task keeps a spanning forest of its links.

Defined cases: as in simhash, but a null, empty or blank text has no shingle and links only
with another such text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import column_bytes, durable, map_arrow, spread
from lexiloom.llm.components import components, with_classes
from lexiloom.llm.simhash import BUCKET, PAIRS, PIVOTS, SEED, TILE, Parts, keep_least
from lexiloom.llm.words import mix, word_hashes

SIMILARITY = 0.8
BITS, DISTANCE, REACH, RECALL = 256, 64, 0.19, 0.99
#: Shingles in a chunk of a group.
SHINGLES = 1 << 20
_PLACES, _SALTS = (np.random.default_rng(SEED + i).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1) for i in (1, 2))
FP = ["f0", "f1", "f2", "f3"]


def shingle_sets(col: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; fewer words than a shingle are one shingle."""
    data, bounds = column_bytes(col)
    h, starts, _ = word_hashes(data, bounds, lower=True)
    cut = np.searchsorted(starts, bounds)
    sums = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        sums += h[k : k + len(sums)] * _PLACES[k]
    sums = mix(sums)
    out = []
    for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if hi - lo >= words:
            out.append(np.unique(sums[lo : hi - words + 1]))
        elif hi > lo:
            out.append(mix((h[lo:hi] * _PLACES[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hash_bits(hashes: np.ndarray) -> np.ndarray:
    wide = np.stack([mix(hashes ^ salt) for salt in _SALTS[: BITS // 64]], axis=1)
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers."""
    if not len(shingles):
        return np.zeros(BITS // 64, np.uint64)
    ones = np.zeros(BITS)
    for lo in range(0, len(shingles), 1 << 14):
        bits = hash_bits(shingles[lo : lo + (1 << 14)])
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
    over = 2 * ones - len(shingles)
    return np.packbits((over > 0) | ((over == 0) & (hash_bits(shingles[:1])[0] > 0)), bitorder="little").view(np.uint64)


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (the node), f0 to f3, size (shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            fps = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, BITS // 64).view(np.int64)
            nodes, sizes = (pa.array([f(s) for s in sets], pa.int64()) for f in (node_of, len))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, *(pa.array(fps[:, i]) for i in range(len(FP))), sizes], ["doc_id", "fp", *FP, "size"])

    rows = spread(docs.select(F.col(id_col).cast("long"), F.col(text_col)))
    return map_arrow(rows, run, "doc_id long, fp long, f0 long, f1 long, f2 long, f3 long, size long", 1)


def samples(nodes: int) -> np.ndarray:
    """The sampled bits, a row for each sample: as long as buckets of unrelated nodes hold about BUCKET, 16 at most."""
    width = min(16, max(8, math.ceil(math.log2(max(1, nodes) / BUCKET))))
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - REACH) ** width))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(BITS, width, replace=False) for _ in range(n)])


def tiled(rows: DataFrame, key: list[str], chunks: DataFrame, name: str) -> DataFrame:
    """rows by key, x, y with their side; those of the keys in chunks (key, chunks) go to each pair of chunks that they are a part of."""
    own = F.pmod(F.xxhash64(name), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = rows.join(chunks, key, "left").withColumn("own", own).withColumn("other", other)
    side: Column = F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    dealt = dealt.withColumns({"x": F.coalesce(F.least("own", "other"), F.lit(-1)), "y": F.coalesce(F.greatest("own", "other"), F.lit(-1)), "side": side})
    key = [*key, "x", "y"]
    return dealt.select(*key, "side", *[c for c in rows.columns if c not in key]).repartition(*key).sortWithinPartitions(*key)


def groups(batches: Iterator[pa.RecordBatch], key: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, about so many rows each, and the bounds of the groups (first columns alike) in them."""

    def bounded(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(t.num_rows - 1, bool)
        for c in t.columns[:key]:
            c = c.to_numpy()
            new |= c[1:] != c[:-1]
        return t, np.concatenate([[0], new.nonzero()[0] + 1, [t.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t, at = bounded(pa.Table.from_batches(held))
            if len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
            held = t.slice(at[-2]).to_batches()
    if held:
        yield bounded(pa.Table.from_batches(held))


def pivot_distances(bucket: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: each node's Hamming distances to PIVOTS nodes spread over its bucket (a number for each node, ascending)."""
    lo, hi = np.searchsorted(bucket, bucket), np.searchsorted(bucket, bucket, side="right")
    seen = np.empty((len(fps), PIVOTS), np.int16)
    for p in range(PIVOTS):
        seen[:, p] = apart(fps, fps[lo + p * (hi - lo) // PIVOTS])
    return seen


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


def possible(seen: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose distances to no pivot differ by more than distance: by the triangle inequality the others are further apart."""
    for p in range(seen.shape[1]):
        keep = np.abs(seen[i, p] - seen[j, p]) <= distance
        i, j = i[keep], j[keep]
    return i, j


def near_fingerprints(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within distance of each bucket (a number for each node, ascending); side: 0 pairs with all, 1 and 2 only with each other.

    Nodes are ordered by their distance to the first pivot, so that only a window is paired; the table discards pairs, survivors are verified.
    """
    seen = pivot_distances(bucket, fps)
    first = bucket.astype(np.int64) * (2 * BITS) + seen[:, 0]
    order = np.argsort(first, kind="stable")
    first, fps, side, seen = first[order], fps[order], side[order], seen[order]
    last = np.searchsorted(first, np.minimum(first + distance, first // (2 * BITS) * (2 * BITS) + 2 * BITS - 1), side="right")
    width = last - np.arange(len(fps)) - 1
    ends, parts, out, lo = np.cumsum(width), Parts(len(fps)), [], 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        if side.any():
            keep = (side[i] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
        roots = parts.roots()
        keep = roots[i] != roots[j]
        i, j = possible(seen, i[keep], j[keep], distance)
        keep = apart(fps[i], fps[j]) <= distance
        for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            x, y = parts.find(a), parts.find(b)
            if x != y:
                parts.up[max(x, y)] = min(x, y)
                out.append((int(order[a]), int(order[b])))
        lo = hi
    return out


def similar_sets(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are so alike: a walk, each set compared with all that aren't reached yet."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(which, kind="stable")]
    stop = np.cumsum(np.bincount(which)) if len(which) else which
    left, out = np.ones(n, bool), []
    for first in range(n):
        walk = [first] if left[first] else []
        left[first] = False
        while walk and left.any():
            i = walk.pop()
            held = which[ends[i] - sizes[i] : ends[i]]
            many = np.diff(stop, prepend=0)[held] if n > 64 else None
            held = held if many is None else held[many > 1]
            met = [owner[stop[k - 1] if k else 0 : stop[k]] for k in held.tolist()]
            common = np.bincount(np.concatenate(met), minlength=n) if met else np.zeros(n, np.int64)
            near = left & (common > 0) & (common >= similarity * (sizes[i] + sizes - common) - 1e-9) & ((side[i] == 0) | (side != side[i]))
            found = near.nonzero()[0].tolist()
            left[found] = False
            out += [(i, j) for j in found]
            walk += found
    return out


def edges_of(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["a", "b"])


def candidates(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that join the nodes (fp, f0 to f3) which sampled bits bring together and distance doesn't part."""
    chosen = samples(nodes.count())
    at = np.int64(1) << np.arange(chosen.shape[1])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            wide = np.stack([c.to_numpy() for c in batch.columns[1:5]], axis=1) if n else np.zeros((0, 4), np.int64)
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
            for w, sample in enumerate(chosen):
                got = bits[:, sample].astype(np.int64) @ at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, w, np.int32)), pa.array(got.astype(np.int32)), *batch.columns], ["which", "bits", "fp", *FP])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, 4, 1 << 15):
            names, side = t["fp"].to_numpy(), t["side"].to_numpy()
            fps = np.stack([t[c].to_numpy() for c in FP], axis=1).view(np.uint64)
            bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            yield edges_of(names, near_fingerprints(bucket, fps, side, distance))

    dealt = nodes.select("fp", *FP).mapInArrow(keys, "which int, bits int, fp long, f0 long, f1 long, f2 long, f3 long")
    key = ["which", "bits"]
    chunks = dealt.groupBy(*key).count().where(F.col("count") > TILE).select(*key, F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("chunks"))
    return tiled(dealt, key, chunks, "fp").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, joined: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that join the nodes of each group of joined (node, root) as pairs of similarity and more do, by exact shingle sets."""
    grouped = durable(joined.join(nodes, joined["node"] == nodes["fp"]).select("node", "root", "least", "size"), "grouped")
    wanted = grouped.select(F.col("least").alias("_least")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["_least"]), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["fp", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, 3, 1024):
            names, side, column = t["fp"].to_numpy(), t["side"].to_numpy(), t["shingles"].combine_chunks()
            pairs = []
            for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                if hi - lo > 1:
                    held = [column[i].values.to_numpy().view(np.uint64) for i in range(lo, hi)]
                    pairs += [(a + lo, b + lo) for a, b in similar_sets(held, side[lo:hi], similarity)]
            yield edges_of(names, pairs)

    rows = map_arrow(texts, sets, "fp long, shingles array<long>", 0).join(grouped.select(F.col("node").alias("fp"), "root"), "fp").dropDuplicates(["fp"])
    n = F.greatest(F.ceil(F.count("*") / (TILE // 2)), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    chunks = grouped.groupBy("root").agg(n.alias("chunks")).where("chunks > 1")
    return tiled(rows.select("root", "fp", "shingles"), ["root"], chunks, "fp").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the node), root (a node that names the class), component_id (the least doc_id that links reach) of each row."""
    marked = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in [*FP, "size"]]), "nodes")
    joined = components(candidates(nodes.where("size > 0")))
    roots = components(verified(docs, nodes, joined, words, similarity, id_col, text_col))
    return with_classes(marked, nodes, roots)


def with_node(docs: DataFrame, name: str, words: int = 5, text_col: str = "text") -> DataFrame:
    """docs with one more column, the node."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([node_of(s) for s in shingle_sets(batch.column(at), words)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*names, name])

    return map_arrow(docs, run, type(docs.schema)(list(docs.schema.fields)).add(name, "long"), at)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with one row of each class of near copies: one with the class's least id."""
    found = durable(classes(docs, words, similarity, id_col, text_col), "classes")
    return keep_least(docs, found, lambda df: with_node(df, "_own_fp", words, text_col), id_col)
