import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(t):
    return len(WORD.findall(t or ""))


def targets(rows):
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size(r.text)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    everything, capped = sum(total.values()), set()
    while True:
        rest = everything - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        want = {s: 3 * total[s] if s in capped else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in capped and want[s] > 3 * total[s]}
        if not above:
            return total, want
        capped |= above


def check(docs, got):
    rows = docs.collect()
    total, want = targets(rows)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r.doc_id, size(r.text), total[r.source]) for r in rows)
    taken = Counter()
    by_size = {total[s]: s for s in total}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for r in got:
        assert any(r.target == pytest.approx(want[s]) for s in total if total[s] == r.source_size)
        taken[by_size[r.source_size]] += r.taken
    if len(by_size) == len(total):
        for s in total:
            assert abs(taken[s] - want[s]) <= 0.5


def test_targets_and_taken(documents):
    got = mixing.taken(documents).collect()
    check(documents, got)
    assert Counter(got) == Counter(mixing.taken(documents.repartition(7)).collect())


def test_odd_documents(odd):
    got = mixing.taken(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), abs=3)


def test_excess_is_reshared(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (1, "b"), (2, "c"), (40, None), (0, "e")])], "doc_id long, text string, source string")
    check(docs, mixing.taken(docs, shards=4, blocks=4).collect())


def test_tree_deals_whole_quotas(documents):
    sources = mixing.source_targets(mixing.sizes(documents), 8, 16)
    drawn = mixing.drawn_blocks(sources, 8).collect()
    per_shard = Counter(r.shard for r in drawn)
    assert set(per_shard) == set(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 3
    assert len({(r.s, r.block, r["pass"]) for r in drawn}) == len(drawn)
    quota = defaultdict(int)
    for r in drawn:
        quota[r.s] += r.to_word - r.from_word
    for s in sources.collect():
        assert quota[s.s] == int(s.target + 0.5)
    with pytest.raises(ValueError):
        mixing.drawn_blocks(sources, 6)


def test_whole_documents_by_shard(spark, documents, odd, tmp_path):
    """The mix holds whole documents, as often as blocks with their first word are drawn, shard by shard in the order of places."""
    got = mixing.materialise(documents)
    assert got.columns == documents.columns
    copies = Counter()
    for r in mixing.taken(documents).collect():
        copies[r.doc_id] += sum(p.split(":")[3] == "0" for p in r.drawn.split(",") if p)
    rows = {r.doc_id: r for r in documents.collect()}
    assert Counter(r.doc_id for r in got.collect()) == +copies and all(r == rows[r.doc_id] for r in got.collect())
    total, want = targets(documents.collect())
    words, longest = Counter(), Counter()
    for r in rows.values():
        words[r.source] += copies[r.doc_id] * size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    assert all(abs(words[s] - want[s]) <= 4 * longest[s] for s in total)
    placed = mixing.dealt(documents).withColumn("part", F.spark_partition_id()).collect()
    order = [(r[mixing.SHARD], r[mixing.PLACE]) for r in sorted(placed, key=lambda r: r.part)]
    assert order == sorted(order) and len({s for s, _ in order}) > 16 and [r.doc_id for r in placed] != sorted(r.doc_id for r in placed)
    mixing.write_mix(documents, str(tmp_path / "m"), "part")
    back = Counter((r.part, r.doc_id) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert back == Counter((r[mixing.SHARD], r.doc_id) for r in placed)
    with pytest.raises(ValueError):
        mixing.write_mix(odd, str(tmp_path / "x"))


def test_whole_documents_of_odd_tables(odd, spark):
    for docs in (odd, odd.groupBy(*odd.columns).count().drop("count")):  # the second is no table of files
        got = mixing.materialise(docs)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
        assert all(size(r.text) for r in got.collect())
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, "z " * 50, "b")], "doc_id long, text string, source string")
    check(long, mixing.taken(long).collect())
    assert {r.doc_id: r.text for r in mixing.materialise(long).collect()}[1] == "w " * 300_000


def test_many_copies_and_sources(spark):
    """Copies of one row, rows without id, and as many sources as rows."""
    rows = [(7, "a b c", "s")] * 200 + [(None, "d e", "s")] * 50 + [(i, "w " * (i % 7), f"t{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs.repartition(6)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    check(docs.where("source = 's'"), mixing.taken(docs.where("source = 's'"), shards=8, blocks=16).collect())
    total, want = targets(docs.collect())
    assert sum(r.taken for r in got) == sum(int(want[s] + 0.5) for s in total)
    again = Counter(r[:5] for r in mixing.taken(docs.repartition(3)).collect())
    assert again == Counter(r[:5] for r in got)


def test_shards_and_quotas_come_from_the_tree(documents):
    pieces = {}
    for shards in (1, 8, 32):
        pieces[shards] = mixing.taken(documents, shards=shards, blocks=16).collect()
        found = [p.split(":") for r in pieces[shards] for p in r.drawn.split(",") if p]
        assert {int(p[0]) for p in found} == set(range(shards)) if shards < 32 else len({p[0] for p in found}) > 16
        assert sum(int(p[4]) for p in found) == sum(r.taken for r in pieces[shards])
    assert {r.doc_id: r.drawn for r in pieces[8]} != {r.doc_id: r.drawn for r in pieces[32]}
    sources = mixing.source_targets(mixing.sizes(documents), 8, 16)
    drawn = mixing.drawn_blocks(sources, 8).collect()
    quota = Counter((r.s, r.shard) for r in drawn)
    assert all(quota[r.s, r.shard] == r.quota for r in drawn)


def test_nothing_to_mix(odd):
    assert mixing.taken(odd.limit(0)).collect() == [] and mixing.materialise(odd.limit(0)).collect() == []


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf_dir, 'documents.parquet')}'")
    got = mixing.op2_mixing(spark, sf_dir)
    want = c.execute(mixing.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 5, 2**63, 2**64 - 1, 12345678901], np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    many = np.arange(20_000, dtype=np.uint64)
    a, b = sharding.jump(many, 24), sharding.jump(many, 25)
    assert set(b[a != b].tolist()) == {24} and 0.03 < (a != b).mean() < 0.05
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


@pytest.mark.parametrize("parts", [1, 5])
def test_shards(odd, parts):
    got = sharding.assign(odd.repartition(parts)).collect()
    want = Counter()
    for r in odd.collect():
        raw, key = (r.text or "").encode(), 2**64 - 1 if r.doc_id is None else r.doc_id
        want[r.doc_id, len(raw) + 8, zlib.crc32(raw), "key", jump(key, 24), jump(key, 25)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(odd.limit(0)).collect() == []


def test_written_shards(spark, documents, odd, tmp_path):
    with pytest.raises(ValueError):
        sharding.write_shards(odd, str(tmp_path / "x"), 4)
    sharding.write_shards(documents, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count()
    assert back.where(F.col("shard") != sharding.shard_of(F.col("doc_id"), 4)).isEmpty()
