"""SimHash near-duplicates by pivot distance tables.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word shingles.
Fingerprints link at max_distance differing bits or fewer; a class is what links reach.

Equal fingerprints are one node. Two nodes within d bits agree on all but d of any d + k
blocks of bits, so every link meets in a bucket of some k agreeing blocks; blocks are as
many as keep buckets small for the number of nodes. Within a bucket, a table holds each
node's Hamming distances to PIVOTS reference fingerprints. By the triangle inequality a
pair whose distances to a pivot differ by more than d is no link: nodes are ordered by the
first distance, so that only a window is paired, the other distances discard pairs by the
maximum coordinate difference, and survivors are verified. A task keeps only links that
join two parts of its bucket, as their classes are all that is asked for; no link between
different texts is lost. A bucket above TILE nodes is cut into buckets again, by agreeing blocks of
the bits that it doesn't agree on; what is above TILE even then holds nodes that are nearly all
alike, and is dealt out as pairs of chunks.

Defined cases: a null, empty or blank text has the fingerprint zero and links like any
other; a text with fewer words than a shingle is one shingle; repeated rows stay and share
a class; a null doc_id is no candidate for a class's id (a class of null ids has id null); very
long texts are read whole, piece by piece; other columns, whatever their names, are not looked at,
or stay as they are where documents are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, map_arrow, spread, table
from lexiloom.sources.tables import small
from lexiloom.llm.components import components, with_classes

SEED, BITS = 42, 64
#: ASCII capitals to small letters, for UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Mean nodes in a bucket, the most in one that a task takes whole, reference fingerprints, pairs looked at together.
BUCKET, TILE, PIVOTS, PAIRS = 32, 4096, 16, 1 << 20
#: Blocks that the buckets of a large bucket agree on, and the columns that name a bucket.
AGAIN, NAMES = 2, 6


def fingerprint(text: str | None, words: int = 4) -> int:
    import xxhash

    raw = (text or "").encode().translate(LOWER)
    found = WORDS.findall(raw)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found[:words]), SEED)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(b" ".join(found[i : i + words]), SEED) for i in range(n)), np.uint64, n)
    return int(majority(hashes))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half the hashes; long texts are counted piece by piece."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        piece = np.ascontiguousarray(hashes[lo : lo + (1 << 16)])
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(spread(docs.select(F.col(id_col).cast("long"), F.col(text_col))), run, "doc_id long, fp long", 1)


def agreeing(nodes: int, distance: int) -> int:
    """How many blocks to ask agreement on, so that buckets of unrelated nodes hold about BUCKET; two at least."""
    k = 2
    while k < 4 and nodes / 2.0 ** (BITS * k / (distance + k)) > BUCKET:
        k += 1
    return k


def masks(distance: int, k: int, bits: list[int] | None = None) -> list[int]:
    """One mask for each choice of k agreeing blocks among distance + k blocks of the given bits (of all)."""
    bits = list(range(BITS)) if bits is None else bits
    blocks = distance + k
    at = [len(bits) * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(each, k)]


def mask_table(found: list[int]) -> Column:
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in found])


def keyed(chosen: Column) -> Column:
    """(which, bits) of fp for each of the masks."""
    return F.transform(chosen, lambda m, i: F.struct(i.cast("short").alias("which"), F.col("fp").bitwiseAND(m).alias("bits")))


class Parts:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def bucket_links(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray, distance: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the linked nodes of each bucket: a spanning forest of the links within distance.

    bucket: a number for each node, ascending. side: 0 pairs with all of its bucket, 1 and 2 only with each other.
    """
    seen = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)  # the pivot distance table
    first = bucket * 256 + seen[:, 0]
    order = np.argsort(first, kind="stable")
    first, fps, side, seen = first[order], fps[order], side[order], seen[order]
    last = np.searchsorted(first, np.minimum(first + distance, (first >> 8 << 8) + 255), side="right")
    width = last - np.arange(len(fps)) - 1
    parts = Parts(len(fps))
    left, right = [], []
    ends = np.cumsum(width)
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        if side.any():
            keep = (side[i] == 0) | (side[j] == 0) | (side[i] != side[j])
            i, j = i[keep], j[keep]
        roots = parts.roots()
        keep = roots[i] != roots[j]
        i, j = i[keep], j[keep]
        for p in range(1, seen.shape[1]):
            if not len(i):
                break
            keep = np.abs(seen[i, p] - seen[j, p]) <= distance
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            x, y = parts.find(a), parts.find(b)
            if x != y:
                parts.up[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
        lo = hi
    return fps[left], fps[right]


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of nodes (fp), enough to connect all that links connect."""
    k = agreeing(nodes.count(), distance)
    first = masks(distance, k)
    again = [masks(distance, AGAIN, [b for b in range(BITS) if not m >> b & 1]) for m in first]  # of the bits that a bucket doesn't agree on
    dealt = nodes.select("fp", F.explode(keyed(mask_table(first))).alias("key")).select("fp", "key.which", "key.bits")
    large = small(dealt.groupBy("which", "bits").count().where(F.col("count") > TILE).drop("count"))
    plain = dealt.join(large, ["which", "bits"], "left_anti")
    whole = plain.select("which", "bits", F.lit(-1).cast("short").alias("which2"), F.lit(0).cast("long").alias("bits2"), "fp")
    whole = whole.withColumns({"x": F.lit(-1), "y": F.lit(-1), "side": F.lit(0).cast("byte")})
    inner = F.try_element_at(F.array(*[mask_table(m) for m in again]), F.col("which") + 1)
    cut = dealt.join(large, ["which", "bits"], "left_semi").select("which", "bits", "fp", F.explode(keyed(inner)).alias("key"))
    cut = cut.select("which", "bits", F.col("key.which").alias("which2"), F.col("key.bits").alias("bits2"), "fp")
    bucket = ["which", "bits", "which2", "bits2"]
    sizes = cut.groupBy(*bucket).count().where(F.col("count") > TILE)
    chunks = small(sizes.select(*bucket, F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.join(chunks, bucket, "left").select(*bucket, "fp", own.alias("own"), other.alias("other")).select(
        *bucket, "fp",
        F.coalesce(F.least("own", "other"), F.lit(-1)).alias("x"),
        F.coalesce(F.greatest("own", "other"), F.lit(-1)).alias("y"),
        F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
    )
    tiled = whole.unionByName(cut)
    key = [*bucket, "x", "y"]
    table_pivots = np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            same = np.ones(len(rows[0]), bool)
            same[0] = False
            for c in rows[:NAMES]:
                same[1:] &= c[1:] == c[:-1]
            a, b = bucket_links(np.cumsum(~same), rows[NAMES].view(np.uint64), rows[NAMES + 1], distance, table_pivots)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in held) < 1 << 16:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = len(rows[0])
            tail = tuple(c[-1] for c in rows[:NAMES])
            differs = np.zeros(cut, bool)  # rows before the last bucket, which may go on in the next batch
            for c, v in zip(rows[:NAMES], tail, strict=True):
                differs |= c != v
            cut = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
            if cut:
                yield done([c[:cut] for c in rows])
            held = [[c[cut:] for c in rows]]
        if held and len(rows := [np.concatenate(c) for c in zip(*held, strict=True)]) and len(rows[0]):
            yield done(rows)

    sorted_rows = tiled.repartition(*key).sortWithinPartitions(*key).select(*key, "fp", "side")
    return sorted_rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the class), component_id (the least doc_id that links reach) of each row."""
    marked = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    return with_classes(marked, nodes, components(links(nodes.select("fp"), distance)))


def with_fingerprint(docs: DataFrame, name: str, words: int = 4, text_col: str = "text") -> DataFrame:
    """docs with one more column, the fingerprint."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*names, name])

    return map_arrow(docs, run, type(docs.schema)(list(docs.schema.fields)).add(name, "long"), at)


def keep_least(docs: DataFrame, found: DataFrame, mark: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The columns of docs, with one row of each class of found (doc_id, fp, root, component_id); mark adds _own_fp, a row's fp.

    Where ids are unique, which is counted, the rows of other ids go. Where some repeat, a row
    is known by id and fp together, and of the rows of a class's chosen pair one stays.
    """
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = found.where(~least).select("doc_id")
        return docs.join(others, docs[id_col].eqNullSafe(others["doc_id"]), "left_anti")
    first = found.where(least).groupBy("root", "component_id").agg(F.min("fp").alias("_keep_fp"))
    first = first.select(F.col("component_id").alias("_keep_id"), "_keep_fp")
    marked = mark(docs)
    kept = marked.join(first, marked[id_col].eqNullSafe(first["_keep_id"]) & (marked["_own_fp"] == first["_keep_fp"]), "left_semi")
    return kept.dropDuplicates([id_col, "_own_fp"]).drop("_own_fp")


def keep_one(docs: DataFrame, words: int = 5, distance: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with one row of each class of fingerprints: one with the class's least id."""
    found = durable(classes(docs, words, distance, id_col, text_col), "classes")
    return keep_least(docs, found, lambda df: with_fingerprint(df, "_own_fp", words, text_col), id_col)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
