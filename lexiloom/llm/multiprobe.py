"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a direction v (scaled to length 1) to the cell floor((a.v + b) / WIDTH) of some
Gaussian projections a. A query visits its own cell and perturbed ones, one step up or down in
some of the projections, in the order of their estimated chance to hold a neighbour: walls are
sorted by their distance from the query, and sets of them by the expected sum of squares, which
depends on the places in that order alone, so that one list serves all queries. Candidates of all
tables are merged, and ranked by their exact cosine in double precision.

The number of projections follows the number of rows, about one for each doubling; the number of
probes is fitted: FIT_QUERIES rows, the first by a hash, are compared with all rows, and as many
probes are taken as find RECALL of their neighbours. Where MOST_PROBES don't suffice, projections
become fewer. All rows are indexed, all queries searched.

Equal vectors are searched once and stand for all their rows: a class keeps the smallest KEEP + 1
ids, enough for any of its members' answers. A task gets a tile: the rows of some cells, and each
query that visits any of them once, with the list of those cells. The rows of a cell that has more
than HOT of all are split among tiles, the queries that visit it in chunks. A task keeps a running
best for each query, so what leaves it grows with its queries. Queries that find fewer than KEEP
others are compared with all rows, in blocks.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take
no part; vectors of different lengths aren't compared; ties go to the smaller id, however many
there are; null ids take no part; repeated ids are separate rows, but a query skips every row of
its own id; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, parts, table
from lexiloom.llm.words import mix

TABLES, WIDTH, RECALL, FIT_QUERIES = 3, 3.0, 0.92, 128
#: Bounds of the projections of a table and of the probes of a query in one.
LEAST_HASHES, MOST_HASHES, LEAST_PROBES, MOST_PROBES = 6, 30, 16, 2048
KEEP, EVERY = 5, 50
#: Rows of a tile, about; queries of a chunk; the share of all rows that makes a cell a large one.
TILE_ROWS, TILE_QUERIES, HOT = 8_192, 8_192, 1 / 128
#: Candidates held before a task thins them out, and those scored exactly at once.
HELD, SCORED = 200_000, 1 << 15
#: Rough cosines are this near to exact ones.
ROUGH = 1e-9
SEED = 5
NAMES = ["t", "tile", "y", "side", "cid", "v", "ids", "cells"]
SCHEMA = "t int, tile long, y int, side int, cid long, v binary, ids array<long>, cells array<int>"


def projections(dim: int, t: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, t))
    return rng.normal(size=(MOST_HASHES, dim))[:hashes].T, rng.uniform(0, WIDTH, MOST_HASHES)[:hashes]


def cell_name(cells: np.ndarray, dim: int, t: int) -> np.ndarray:
    """A 64-bit name of each row's cell; two cells of one name would only share their candidates."""
    name = np.full(cells.shape[:-1], dim * 1_000_003 + t, np.uint64)
    for i in range(cells.shape[-1]):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
    return name.view(np.int64)


def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of walls, by their places from 0 in the order of distance, the likeliest first; the empty one is the query's own cell.

    Of 2 * hashes walls, the two of one projection have the places j and 2 * hashes - 1 - j. The expected
    square of the distance at each place is that of the order statistics of uniform numbers.
    """
    k = hashes
    cost = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)]
    cost += [1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 2 * k)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        _, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * k:
            for grown in ((*chosen[:-1], last + 1), (*chosen, last + 1)):
                heapq.heappush(heap, (sum(cost[j] for j in grown), grown))
        if len({min(j, 2 * k - 1 - j) for j in chosen}) == len(chosen):
            out.append(chosen)
    return out


def steps_of(sets: list[tuple[int, ...]], inside: np.ndarray) -> np.ndarray:
    """The perturbations (queries x probes x hashes; -1, 0, 1) of queries at these distances above their cells' lower walls."""
    n, k = inside.shape
    order = np.argsort(np.concatenate([inside, WIDTH - inside], axis=1), axis=1, kind="stable")
    out = np.zeros((n, len(sets), k), np.int8)
    for p, chosen in enumerate(sets):
        for j in chosen:
            wall = order[:, j]
            out[np.arange(n), p, wall % k] = np.where(wall < k, -1, 1)
    return out


def cells_of(unit: np.ndarray, t: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of directions, and how far inside they lie."""
    a, b = projections(unit.shape[1], t, hashes)
    spot = unit @ a + b
    cells = np.floor(spot / WIDTH).astype(np.int64)
    return cells, spot - cells * WIDTH


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # neither very large nor very small components over- or underflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(column.offsets.to_numpy())
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    for dim in np.unique(lengths):
        rows = (lengths == dim).nonzero()[0]
        yield rows, values[at[rows][:, None] + np.arange(dim)].astype(float)


class Plan:
    """The parameters that were fitted, and the large cells: (t, cell) to the numbers of parts of its rows and of its queries.

    Column t numbers the tables of each length of vectors.
    """

    def __init__(self, hashes: int, probes: int, tiles: int, kind: str):
        self.hashes, self.probes, self.tiles, self.kind = hashes, probes, tiles, kind
        self.large: dict[tuple[int, int], tuple[int, int]] = {}


def short(names: np.ndarray) -> np.ndarray:
    """Half of a cell's name, enough within a tile: two cells that share it share their candidates."""
    return (names >> 32).astype(np.int32)


def tile_of(cells: np.ndarray, plan: Plan) -> np.ndarray:
    return (mix(cells.view(np.uint64)) % np.uint64(plan.tiles)).astype(np.int64)


def dealt_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """Each class in the tile of its cell, for each table; those of large cells in a tile of their own, once for each chunk of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            for rows, x in by_length(batch.column("v")):
                unit, raw = unit_rows(x), x.astype(plan.kind, copy=False)
                for t in range(TABLES):
                    names = cell_name(cells_of(unit, t, plan.hashes)[0], x.shape[1], t)
                    own = x.shape[1] * TABLES + t
                    tile, y = tile_of(names, plan), np.zeros(len(rows), np.int32)
                    who = np.arange(len(rows))
                    for (of, cell), (xs, ys) in plan.large.items():
                        if of == own and len(mine := (short(names) == cell).nonzero()[0]):
                            tile[mine] = -1 - (mix(cid[rows[mine]].view(np.uint64)) % np.uint64(xs)).astype(np.int64) * 1_000_003 - abs(cell) % 1_000_003
                            who = np.concatenate([who, np.repeat(mine, ys - 1)])
                            y = np.concatenate([y, np.tile(np.arange(1, ys, dtype=np.int32), len(mine))])
                    got = batch.take(pa.array(rows[who]))
                    n = len(who)
                    one = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(short(names[who])))
                    columns = [np.full(n, own, np.int32), tile[who], y, np.ones(n, np.int32), got.column("cid"), pa.array([r.tobytes() for r in raw[who]], pa.binary()), got.column("ids"), one]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return classes.select("cid", "v", "ids").mapInArrow(run, SCHEMA)


def probed(unit: np.ndarray, t: int, plan: Plan, sets: list[tuple[int, ...]]) -> np.ndarray:
    """The names of the cells that each query visits in a table."""
    cells, inside = cells_of(unit, t, plan.hashes)
    return cell_name(cells[:, None, :] + steps_of(sets, inside), unit.shape[1], t)


def dealt_queries(asking: DataFrame, plan: Plan) -> DataFrame:
    """Each query class in every tile that holds cells it visits, with these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = probe_sets(plan.hashes, plan.probes)
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            for rows, x in by_length(batch.column("v")):
                unit, raw = unit_rows(x), x.astype(plan.kind, copy=False)
                for lo in range(0, len(rows), 256):
                    for t in range(TABLES):
                        names = probed(unit[lo : lo + 256], t, plan, sets)
                        own = x.shape[1] * TABLES + t
                        who = np.repeat(np.arange(lo, lo + len(names)), names.shape[1])
                        names = names.ravel()
                        tile, y = tile_of(names, plan), np.zeros(len(names), np.int32)
                        for (of, cell), (xs, ys) in plan.large.items():
                            if of == own and len(mine := (short(names) == cell).nonzero()[0]):
                                chunk = (mix(cid[rows[who[mine]]].view(np.uint64) + np.uint64(1)) % np.uint64(ys)).astype(np.int32)
                                tile = np.concatenate([tile, *[np.full(len(mine), -1 - i * 1_000_003 - abs(cell) % 1_000_003) for i in range(xs)]])
                                y, who, names = np.concatenate([y, np.tile(chunk, xs)]), np.concatenate([who, np.tile(who[mine], xs)]), np.concatenate([names, np.tile(names[mine], xs)])
                                tile[mine] = -1  # no tile
                        keep = tile != -1
                        tile, y, who, names = tile[keep], y[keep], who[keep], names[keep]
                        order = np.lexsort((tile, y, who))
                        tile, y, who, names = tile[order], y[order], who[order], names[order]
                        new = np.ones(len(who), bool)
                        new[1:] = (tile[1:] != tile[:-1]) | (y[1:] != y[:-1]) | (who[1:] != who[:-1])
                        at = new.nonzero()[0]
                        n = len(at)
                        got = batch.take(pa.array(rows[who[at]]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(who)).astype(np.int32)), pa.array(short(names)))
                        columns = [np.full(n, own, np.int32), tile[at], y[at], np.zeros(n, np.int32), got.column("cid"), pa.array([r.tobytes() for r in raw[who[at]]], pa.binary()), got.column("ids"), lists]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return asking.select("cid", "v", "ids").mapInArrow(run, SCHEMA)


class Best:
    """For queries (by number), their KEEP + 1 best candidates so far, exactly scored; at equal scores the class of the least id."""

    def __init__(self, x: np.ndarray):
        self.x, self.unit = x, unit_rows(x)
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.least = np.full(len(x), -2.0)  # what a rough score must reach
        self.found = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64)]
        self.members = np.zeros(0, object)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def offer(self, q: np.ndarray, x: np.ndarray, unit: np.ndarray, cid: np.ndarray, members: np.ndarray) -> None:
        """Compare the queries q with these rows."""
        step = max(1, (1 << 22) // max(1, len(x)))
        for lo in range(0, len(q), step):
            some = q[lo : lo + step]
            rough = self.unit[some] @ unit.T
            i, j = (rough >= self.least[some][:, None] - ROUGH).nonzero()
            for a in range(0, len(i), SCORED):
                qs, rs = some[i[a : a + SCORED]], j[a : a + SCORED]
                y = x[rs]
                score = (self.x[qs] * y).sum(axis=1) / (self.norm[qs] * np.sqrt((y * y).sum(axis=1)))
                self.held.append((qs, cid[rs], score, members[rs]))
                self.n += len(qs)
                if self.n > HELD:
                    self.thin()

    def thin(self) -> None:
        q, c, s, m = (np.concatenate(z) for z in zip((self.found[0], self.found[1], self.found[2], self.members), *self.held, strict=True))
        first = np.array([ids[0] for ids in m], np.int64)
        order = np.lexsort((c, first, -s, q))
        q, c, s, first, m = q[order], c[order], s[order], first[order], m[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s, first, m = q[new], c[new], s[new], first[new], m[new]
        begin = np.ones(len(q), bool)
        begin[1:] = q[1:] != q[:-1]
        at = np.arange(len(q))
        rank = at - np.maximum.accumulate(np.where(begin, at, 0))
        keep = rank <= KEEP
        full = rank == KEEP
        self.least[q[full]] = s[full]
        self.found, self.members = [q[keep], c[keep], s[keep], first[keep]], m[keep]
        self.held, self.n = [], 0

    def rows(self, cid: np.ndarray) -> pa.RecordBatch:
        self.thin()
        q, c, s, _ = self.found
        return pa.RecordBatch.from_arrays([pa.array(cid[q]), pa.array(c), pa.array(s), pa.array(self.members.tolist(), pa.list_(pa.int64()))], ["q", "c", "score", "ids"])


def search(tiled: DataFrame, kind: str) -> DataFrame:
    """q, c, score, ids: for each query class and tile the best classes met there."""
    key = ["t", "tile", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        held: list[pa.RecordBatch] = []
        best: Best | None = None
        cid = probe_cells = probe_query = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("t", "tile", "y", "side")]
            edge = np.ones(batch.num_rows, bool)
            edge[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            edges = [*edge.nonzero()[0].tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                name = tuple(int(c[lo]) for c in columns[:3])
                if name != here:
                    if best is not None:
                        yield best.rows(cid)
                    here, held, best = name, [], None
                if not columns[3][lo]:
                    held.append(part)
                    continue
                if best is None:
                    if not held:
                        continue
                    queries = pa.Table.from_batches(held).combine_chunks()
                    lists = queries["cells"].combine_chunks()
                    cid = queries["cid"].to_numpy()
                    probe_query = np.repeat(np.arange(len(cid)), np.diff(lists.offsets.to_numpy()))
                    probe_cells = lists.flatten().to_numpy()
                    order = np.argsort(probe_cells, kind="stable")
                    probe_cells, probe_query = probe_cells[order], probe_query[order]
                    best = Best(np.stack([np.frombuffer(v, kind) for v in queries["v"].to_pylist()]).astype(float))
                x = np.stack([np.frombuffer(v, kind) for v in part.column("v").to_pylist()]).astype(float)
                cells = part.column("cells").flatten().to_numpy()
                order = np.argsort(cells, kind="stable")
                members = np.empty(len(x), object)
                members[:] = part.column("ids").to_pylist()
                x, cells, members, rows = x[order], cells[order], members[order], part.column("cid").to_numpy()[order]
                unit = unit_rows(x)
                starts = np.concatenate([[0], (cells[1:] != cells[:-1]).nonzero()[0] + 1, [len(cells)]])
                names = cells[starts[:-1]]
                a, b = np.searchsorted(probe_cells, names), np.searchsorted(probe_cells, names, side="right")
                for k in (b > a).nonzero()[0].tolist():
                    s = slice(starts[k], starts[k + 1])
                    best.offer(probe_query[a[k] : b[k]], x[s], unit[s], rows[s], members[s])
        if best is not None:
            yield best.rows(cid)

    ordered = tiled.repartition(*key).sortWithinPartitions(*key, "side")
    return ordered.mapInArrow(run, "q long, c long, score double, ids array<long>")


def against_all(classes: DataFrame, asking: DataFrame, kind: str) -> DataFrame:
    """The same as search, of these queries with all rows of their length, in blocks."""
    blocks = parts(classes.sparkSession)

    def blank(df: DataFrame, side: int, tile) -> DataFrame:
        return df.select(F.size("v").alias("t"), tile.cast("long").alias("tile"), F.lit(0).alias("y"), F.lit(side).alias("side"), "cid", "v", "ids")

    def binary(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = pa.array([np.array(v, kind).tobytes() for v in batch.column("v").to_pylist()], pa.binary())
                one = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32)), pa.array(np.zeros(batch.num_rows, np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in NAMES[:5]], raw, batch.column("ids"), one], NAMES)

        return df.mapInArrow(run, SCHEMA)

    rows = blank(classes, 1, F.pmod(F.xxhash64("cid"), F.lit(blocks)))
    queries = blank(asking.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("tile")), 0, F.col("tile"))
    return search(binary(rows.unionByName(queries)), kind)


def against_sample(classes: DataFrame, sample: dict[int, np.ndarray]) -> DataFrame:
    """The same for a bounded sample of queries, which each task gets whole; no row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Best, np.ndarray]] = {}
        for dim in {len(v) for v in sample.values()}:
            cid = np.array([c for c, v in sample.items() if len(v) == dim])
            best[dim] = Best(np.stack([sample[c] for c in cid.tolist()])), cid
        for batch in batches:
            cid, ids = batch.column("cid").to_numpy(), batch.column("ids").to_pylist()
            for rows, x in by_length(batch.column("v")):
                if x.shape[1] in best:
                    members = np.empty(len(rows), object)
                    members[:] = [ids[i] for i in rows.tolist()]
                    of = best[x.shape[1]][0]
                    of.offer(np.arange(len(of.x)), x, unit_rows(x), cid[rows], members)
        for of, cid in best.values():
            if of.n or len(of.found[0]):
                yield of.rows(cid)

    return classes.select("cid", "v", "ids").mapInArrow(run, "q long, c long, score double, ids array<long>")


def best_of(met: DataFrame, keep: int) -> DataFrame:
    """The keep + 1 best distinct classes of each query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    return met.dropDuplicates(["q", "c"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep + 1)


def fitted(classes: DataFrame, n: int, kind: str) -> Plan:
    """Projections and probes that find RECALL of the neighbours of FIT_QUERIES classes, found by comparing these with all."""
    tiles = max(1, math.ceil(n / TILE_ROWS))
    most = min(MOST_HASHES, max(LEAST_HASHES, round(math.log2(max(2, n)))))
    sample = {r.cid: np.array(r.v, float) for r in classes.orderBy(F.xxhash64("h1", F.lit(SEED)), "cid").limit(FIT_QUERIES).select("cid", "v").collect()}
    near = best_of(against_sample(classes, sample), KEEP).where("q <> c").select("q", "c")  # FIT_QUERIES x (KEEP + 1) at most
    found = classes.join(F.broadcast(near), F.col("cid") == F.col("c")).select("q", "v").collect()
    pairs = [(sample[r.q], np.array(r.v, float)) for r in found]
    for hashes in range(most, LEAST_HASHES - 1, -1):
        plan = Plan(hashes, MOST_PROBES, tiles, kind)
        sets = probe_sets(hashes, MOST_PROBES)
        if not pairs:
            break
        needed = np.sort(first_probes(pairs, hashes, sets))
        enough = needed[max(0, math.ceil(RECALL * len(needed)) - 1)]
        if enough < MOST_PROBES:
            plan.probes = max(int(enough) + 1, LEAST_PROBES)
            break
    return plan


def first_probes(pairs: list[tuple[np.ndarray, np.ndarray]], hashes: int, sets: list[tuple[int, ...]]) -> np.ndarray:
    """The number of the first probe of v that meets w in any table, for each pair of vectors."""
    number = {frozenset(chosen): p for p, chosen in enumerate(sets)}
    out = np.full(len(pairs), len(sets))
    for t in range(TABLES):
        for i, (v, w) in enumerate(pairs):
            (of_v, of_w), inside = cells_of(unit_rows(np.stack([v, w])), t, hashes)
            step = of_w - of_v
            if np.abs(step).max() <= 1:
                place = np.argsort(np.argsort(np.concatenate([inside[0], WIDTH - inside[0]]), kind="stable"))
                walls = step.nonzero()[0]
                out[i] = min(out[i], number.get(frozenset(place[np.where(step[walls] < 0, walls, walls + hashes)].tolist()), len(sets)))
    return out


def large_cells(rows: DataFrame, asking: DataFrame, plan: Plan, n: int) -> None:
    """Name the cells of more than HOT of all rows, fewer than TABLES / HOT, and how many parts their rows and queries make."""
    cells = rows.select("t", F.col("cells")[0].alias("cell")).groupBy("t", "cell").count()
    hot = cells.where(F.col("count") > max(TILE_ROWS, HOT * n)).collect()
    if hot:
        visits = dealt_queries(asking, plan).select("t", F.explode("cells").alias("cell"))
        few = F.broadcast(rows.sparkSession.createDataFrame([(r.t, r.cell) for r in hot], "t int, cell int"))
        asked = {(r.t, r.cell): r["count"] for r in visits.join(few, ["t", "cell"]).groupBy("t", "cell").count().collect()}
        plan.large = {(r.t, r.cell): (math.ceil(r["count"] / max(TILE_ROWS, HOT * n)), math.ceil(asked.get((r.t, r.cell), 1) / TILE_QUERIES)) for r in hot}


def nearest(rows: DataFrame, every: int = EVERY, keep: int = KEEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the keep (at most KEEP) nearest rows of each row whose id is divisible by every."""
    if not 1 <= keep <= KEEP:
        raise ValueError(f"keep must be from 1 to {KEEP}")
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = rows.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    valid = valid.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    some = valid.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("k") <= keep + 1)
    classes = some.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    queries = valid.where(F.col("id") % every == 0).select("id", "h1", "h2")
    asked = durable(queries.join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("cid").alias("q")), "queries")
    asking = durable(classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi"), "asking")

    n = classes.count()
    plan = fitted(classes, n, kind)
    large_cells(dealt_rows(classes, plan), asking, plan, n)
    met = durable(search(dealt_rows(classes, plan).union(dealt_queries(asking, plan)), kind), "met")

    # the few that met too little, against all rows: blocks of rows, each with all these queries
    enough = met.select("q", F.explode("ids").alias("id")).groupBy("q").agg(F.countDistinct("id").alias("n")).where(F.col("n") > keep)
    starved = asking.join(enough.select(F.col("q").alias("cid")), "cid", "left_anti")
    if not starved.isEmpty():
        met = met.union(against_all(classes, starved, kind))

    pairs = asked.join(best_of(met, keep), "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= keep)


def op5_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
