"""Order MinHash fingerprints, sensitive to edits and to order.

The k-mers are runs of K words; equal ones of a text are numbered by occurrence, so that
repeats count. Each of SKETCHES hash functions selects the TUPLE numbered k-mers with the
least values; they are put back into text order and hashed together to one component of the
signature. Two texts' likeness is the share of equal components.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint,
and two such are alike (1), one and another text aren't (0); a text with fewer than K words
is one k-mer; with fewer than TUPLE k-mers all of them are taken; very long texts are taken
whole, alone in their batch; repeated rows stay, and equal ids follow each other in the order of
their texts' hashes; null doc_ids come first; the next document of the last is the first, of a
single one itself; other columns, whatever their names, are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_arrow, parts, table
from lexiloom.llm.words import mix, word_hashes

K, SKETCHES, TUPLE = 5, 64, 2
#: Bits of a k-mer's place in its text, below its hash in a 64-bit number; a text of more k-mers than the first can number takes the second, enough for any string.
PLACE, WIDE_PLACE = 28, 31
#: Texts are fingerprinted together up to so many bytes.
TOGETHER = 1 << 21
RANGES = 8
#: Low bits of the order of equal ids, by which copies of one text are told apart.
COPY_BITS = 20
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (SKETCHES + K + 4, 2), np.uint64) | np.uint64(1)


def numbered_kmers(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' k-mers, as hashes that differ between occurrences, and where each text's begin (one more at the end)."""
    bounds = np.cumsum([0, *map(len, raw)])
    words, starts, _ = word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds)
    first = np.searchsorted(starts, bounds)
    row = np.repeat(np.arange(len(raw)), np.diff(first))
    here = np.arange(len(words))
    end = first[1:][row]
    kmers = np.zeros(len(words), np.uint64)
    for j in range(K):
        at = here + j
        kmers[: len(words) - j] += np.where(at < end, np.pad(words[j:], (0, min(j, len(words)))), np.uint64(0))[: len(words) - j] * _SEEDS[SKETCHES + j, 0]
    keep = (here + K <= end) | (here == first[:-1][row])
    kmers, row = mix(kmers[keep]), row[keep]
    begins = np.searchsorted(row, np.arange(len(raw) + 1))
    together = kmers ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(together, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = together[order][1:] != together[order][:-1]
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(kmers + occurrence * _SEEDS[-1, 0]), begins


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The signature of each text: SKETCHES unsigned 32-bit numbers, or none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    n = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if held and n + len(raw) > TOGETHER:
            out += _signatures(held)
            held, n = [], 0
        held.append(raw)
        n += len(raw)
    return out + (_signatures(held) if held else [])


def _signatures(raw: list[bytes]) -> list[np.ndarray]:
    kmers, begins = numbered_kmers(raw)
    some = (np.diff(begins) > 0).nonzero()[0]
    none = np.zeros(0, np.uint32)
    out = [none] * len(raw)
    if not len(some):
        return out
    heads = begins[some]
    place = (np.arange(len(kmers)) - np.repeat(heads, np.diff(begins)[some])).astype(np.uint64)
    bits = PLACE if len(kmers) <= 1 << PLACE else WIDE_PLACE  # such a text is alone here, as it exceeds TOGETHER
    low, top = np.uint64((1 << bits) - 1), np.uint64(0xFFFFFFFFFFFFFFFF)
    found = np.empty((len(some), SKETCHES), np.uint32)
    for i in range(SKETCHES):
        v = (kmers ^ _SEEDS[i, 0]) * _SEEDS[i, 1]
        v ^= v >> np.uint64(32)
        v *= _SEEDS[i, 0]
        v &= ~low
        v |= place
        chosen = []
        for _ in range(TUPLE):
            least = np.minimum.reduceat(v, heads)
            have = least != top
            at = heads + np.where(have, least & low, 0).astype(np.int64)
            v[at[have]] = top
            chosen.append(np.where(have, at, np.iinfo(np.int64).max))
        in_order = np.sort(np.stack(chosen), axis=0)
        code = np.zeros(len(some), np.uint64)
        for at in in_order:
            have = at < len(kmers)
            code = np.where(have, mix(code * _SEEDS[-2, 0] + kmers[np.where(have, at, 0)]), code)
        found[:, i] = code >> np.uint64(32)
    for k, row in zip(some.tolist(), found, strict=True):
        out[k] = row
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class Ranges:
    """Consecutive ranges of (id, order): bounds between ids, and for some ids bounds of the order too. Null is below all ids."""

    def __init__(self, ids: list[int], inner: dict[int | None, list[int]]):
        for k in inner:  # such an id has ranges of its own
            ids = [*ids, *([LEAST] if k is None else [k, k + 1] if k < GREATEST else [k])]
        self.ids = np.array(sorted(set(ids)), np.int64)
        self.inner = {0 if k is None else int(np.searchsorted(self.ids, k)) + 1: np.unique(np.array(v, np.int64)) for k, v in inner.items()}
        sizes = np.ones(len(self.ids) + 1, np.int64)
        for at, v in self.inner.items():
            sizes[at] += len(v)
        self.first = np.cumsum(sizes) - sizes

    def __call__(self, keys: pd.Series, order: pd.Series) -> np.ndarray:
        null = keys.isna().to_numpy()
        at = np.where(null, 0, np.searchsorted(self.ids, keys.fillna(0).to_numpy(np.int64), side="right"))
        out = self.first[at]
        for j, bounds in self.inner.items():
            mine = (at == j).nonzero()[0]
            out[mine] += np.searchsorted(bounds, order.to_numpy()[mine], side="right")
        return out.astype(np.int32)


def ranges(rows: DataFrame, n: int) -> Ranges:
    """About n ranges of like numbers of rows (k, w): by quantiles of the ids, and of the order where one id has more rows than a range."""
    total = rows.count()
    if not total or n < 2:
        return Ranges([], {})
    steps = [i / n for i in range(1, n)]
    ids = rows.agg(F.percentile_approx("k", steps, 10_000)).first()[0] or []
    hot = rows.groupBy("k").count().where(F.col("count") > total / n)  # fewer than n rows
    inside = rows.join(F.broadcast(hot.select(F.col("k").alias("h"))), F.col("k").eqNullSafe(F.col("h"))).groupBy("k")
    inner = {}
    for r in inside.agg(F.count("*").alias("c"), F.percentile_approx("w", steps, 10_000).alias("w")).collect():
        every = max(1, total // r.c)  # one quantile for each range that the id fills
        inner[r.k] = r.w[every - 1 :: every]
    return Ranges(ids, inner)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every document, of its text edited with the next one's, and both likenesses.

    Documents are dealt by ranges of ids, several for each task. The first document of a range
    also goes, marked, to the end of the range before it, so each range has all the texts it needs.
    An id of many rows is cut into ranges by the hash of the text, and copies of one text by the
    rows' places in the input (which must read the same each time, as files do).
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    copy = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << COPY_BITS) - 1).cast("long"))
    w = F.xxhash64("t").bitwiseAND(F.lit(-1 << COPY_BITS).cast("long")).bitwiseOR(copy)
    chosen = chosen.select("k", "t", w.alias("w"))
    ids = chosen.select("k", "w")
    dealing = ranges(ids, parts(spark) * RANGES)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series(dealing(keys, order))

    part = range_of(F.col("k"), F.col("w"))
    heads = ids.groupBy(part.alias("p")).agg(F.min(F.struct(F.col("k").isNotNull().alias("some"), "k", "w")).alias("m")).collect()  # one row a range
    heads = sorted((r.p, r.m.k, r.m.w) for r in heads)
    to = spark.createDataFrame([(k, w, heads[i - 1][0]) for i, (_, k, w) in enumerate(heads)], "k long, w long, p int")  # the range before, of the first the last
    heads_only = chosen.join(F.broadcast(to), chosen["k"].eqNullSafe(to["k"]) & (chosen["w"] == to["w"])).select(to["p"], F.lit(1).alias("extra"), chosen["k"], "t", chosen["w"])
    dealt = chosen.select(part.alias("p"), F.lit(0).alias("extra"), "k", "t", "w").union(heads_only)
    ordered = dealt.repartitionByRange(parts(spark), "p").sortWithinPartitions("p", "extra", "k", "w").select("p", "extra", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int | None, str]] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            done, held = held, held[-1:]
            if any(not r[1] for r in done[:-1]):
                yield answer(done)

    def answer(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
        own = [i for i, r in enumerate(rows[:-1]) if not r[1]]
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in own]
        found = signatures([r[3] for r in rows])
        new = signatures(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], pa.int64()),
                pa.array([len(rows[i][3]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([found[i].astype(">u4").tobytes().hex() for i in own]),
                pa.array([s.astype(">u4").tobytes().hex() for s in new]),
                pa.array([likeness(found[i], s) for i, s in zip(own, new, strict=True)]),
                pa.array([likeness(found[i], found[i + 1]) for i in own]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return map_arrow(ordered, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", 3)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
