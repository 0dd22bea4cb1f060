"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in the order of a hash of id and size. The
stream is cut into blocks of about equal words. A source's target says how many blocks the
mix draws from it: whole passes over the stream, then blocks in a permuted order, the last
one cut so that the words drawn are the target to the word. A tree splits all drawn blocks
among the output shards: each node deals its blocks at random to two halves, which makes
the counts of each source in a half a multivariate-hypergeometric draw with exact quotas.
A shard then takes, of each source, the next disjoint run of its permuted blocks, and puts
its pieces in a shuffled order. All of it is DataFrame operations; hashes replace random
numbers, so reruns agree.

The number of drawn blocks is set by the parameters (SHARDS x BLOCKS, and at most a few for
each source), so the tree stays small however large the data are. Ranks and running sums are
taken in two levels, over groups named by the first digits of a hash and within one (streams
have a third level for copies of one document), sources are numbered by ranges, and a source of
many documents is looked up apart, so neither a large source, nor many sources, nor many copies
of a document meet in one task.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and share the sum
of all sizes; a target stops at 3 times its source's size, and the excess is shared by weight
until none is above.

Defined cases: a null or blank text has size 0 and is not taken; a very long text may span many
blocks and shards; null sources are one source; a null doc_id hashes as the empty string;
repeated rows are separate rows, of which any may be the first; other columns, whatever their
names, are not looked at, or stay as they are where documents are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, numbered, parts, skew_join, table

SHARDS, BLOCKS = 32, 64
WORD = r"[^\x20\x09-\x0D]+"
#: The most times a document is taken.
REPEATS = 3
#: Hexadecimal digits of a hash that name a group: of documents in a stream, of blocks.
GROUP_DIGITS, BLOCK_DIGITS = 3, 2
#: Rows up to which the table of drawn blocks is broadcast (under 100 bytes a row).
BROADCAST_ROWS = 100_000
#: Names that no column of the documents should have.
RID, SHARD, PLACE = "_mix_rid", "_mix_shard", "_mix_place"


def _key(source: Column) -> Column:
    """A string for each source, and another one for null."""
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source.cast("string"), F.lit("")))


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rid: Column | None = None) -> DataFrame:
    """Narrow rows (rid, doc_id, source, size, split, h), written once; rid tells rows apart and is numbered here, unless it is given."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rid = F.monotonically_increasing_id() if rid is None else rid
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), rid.alias("rid"), F.spark_partition_id().alias("split"))
    return durable(rows.withColumn("h", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))), "sizes")


def source_targets(rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(source, s, n, source_size, target, whole, rest, n_blocks) of each source; s numbers the sources from 0, n counts its rows."""
    w = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    w = numbered(w, [F.col("source").asc_nulls_last()], "s")
    w = w.withColumns({"weight": F.col("s") % 3 + 1, "cap": F.col("source_size") * REPEATS})
    total, left = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # what a unit of weight gets, with the sources that this fills at their caps; it rises until no further source is filled
    unit, full = total / left if left else 0.0, None
    while left:
        filled = F.col("cap") / F.col("weight") <= unit
        capped = w.agg(F.coalesce(F.sum(F.when(filled, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0))).first()
        if capped == full or not capped[1]:
            break
        full, unit = capped, (total - capped[0]) / capped[1]
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(unit))))
    words = F.floor(F.col("target") + 0.5).cast("long")
    step = max(-(-total // (shards * blocks)), 1)
    some = F.col("source_size") > 0
    return w.select(
        "source", "s", "n", "source_size", "target",
        F.when(some, F.expr("cast(floor(target + 0.5) as bigint) div greatest(source_size, 1)")).otherwise(0).alias("whole"),
        F.when(some, words % F.greatest("source_size", F.lit(1))).otherwise(0).alias("rest"),
        F.when(some, F.ceil(F.col("source_size") / step)).otherwise(0).cast("long").alias("n_blocks"),
    )


def ranked(df: DataFrame, by: list[str], mark: str, last: list[str], sums: dict[str, str]) -> DataFrame:
    """df with place, the rank from 0 within by in the order of a hash, mark, and last; and by name the sums of columns over the ranks before."""
    zero = F.lit(0).cast("long")
    df = df.withColumn("_g", F.substring(mark, 1, BLOCK_DIGITS))
    ahead = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(*by, "_g").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_n_{k}") for k, c in sums.items()])
    groups = groups.select(*by, "_g", F.coalesce(F.sum("_n").over(ahead), zero).alias("_n"), *[F.coalesce(F.sum(f"_n_{k}").over(ahead), zero).alias(f"_n_{k}") for k in sums])
    inside = Window.partitionBy(*by, "_g").orderBy(mark, *last)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_in": F.row_number().over(inside) - 1, **{f"_in_{k}": F.coalesce(F.sum(c).over(before), zero) for k, c in sums.items()}})
    names = [c for c in df.columns if not c.startswith("_")]
    return df.join(groups, [*by, "_g"]).select(*names, (F.col("_n") + F.col("_in")).alias("place"), *[(F.col(f"_n_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def drawn_blocks(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(s, block, pass, from_word, to_word, shard, quota) of every block drawn; words count along the source's stream, quota is the shard's number of the source's blocks."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    of = sources.where("n_blocks > 0")
    b = of.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    b = b.withColumns({"from_word": F.expr("block * source_size div n_blocks"), "to_word": F.expr("(block + 1) * source_size div n_blocks")})
    b = b.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("pass"))
    b = b.withColumns({"mark": F.md5(F.concat_ws("|", F.lit("block"), "s", "pass", "block")), "words": F.col("to_word") - F.col("from_word")})
    b = ranked(b, ["s", "pass"], "mark", ["block"], {"before": "words"})
    room = F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.col("rest") - F.col("before"))
    b = b.withColumn("to_word", F.least("to_word", F.col("from_word") + room)).where("to_word > from_word")
    # blocks of the passes before are all drawn
    b = durable(b.select("s", "block", "pass", "from_word", "to_word", (F.col("pass") * F.col("n_blocks") + F.col("place")).alias("k")), "blocks")

    # the tree: unnamed blocks (s, j) go down, half of a node's to either side; one random order serves all levels, being random within any part of it
    mark = F.md5(F.concat_ws("|", F.lit("tree"), "s", "j"))
    t = ranked(b.select("s", F.col("k").alias("j")).withColumn("mark", mark), [], "mark", ["s", "j"], {})
    t = t.withColumns({"node": F.lit(0), "held": F.lit(b.count()).cast("long")})
    for _ in range(shards.bit_length() - 1):
        half = F.expr("(held + 1) div 2")
        right = F.col("place") >= half
        t = t.select("s", "j", (F.col("node") * 2 + right.cast("int")).alias("node"), F.when(right, F.col("place") - half).otherwise(F.col("place")).alias("place"), F.when(right, F.col("held") - half).otherwise(half).alias("held"))
    quota = t.groupBy("s", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))
    upto = F.sum("quota").over(Window.partitionBy("s").orderBy("shard"))  # a shard's run of the source's blocks ends here
    quota = quota.withColumn("upto", upto)
    quota = quota.select("s", "shard", "quota", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("k"))
    return b.join(quota, ["s", "k"]).select("s", "block", "pass", "from_word", "to_word", "shard", "quota")


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's columns and start, the words before the document in its stream."""
    zero = F.lit(0).cast("long")
    found = sources.withColumn("key", _key(F.col("source"))).drop("source")
    r = skew_join(rows.withColumn("key", _key(F.col("source"))).drop("source"), found, "key", rows.count()).drop("key")
    r = r.withColumn("g", F.substring("h", 1, GROUP_DIGITS))
    one = ["s", "g", "h", "split"]  # a document, or its copies in one split of the input
    before = Window.partitionBy(*one).orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inner", F.coalesce(F.sum("size").over(before), zero))
    of_one = r.groupBy(*one).agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("s", "g").orderBy("h", "split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = r.groupBy("s", "g").agg(F.sum("size").alias("words")).select("s", "g", F.coalesce(F.sum("words").over(ahead), zero).alias("base"))
    of_one = of_one.withColumn("offset", F.coalesce(F.sum("words").over(inside), zero)).join(groups, ["s", "g"])
    of_one = of_one.select(*one, (F.col("offset") + F.col("base")).alias("base"))
    return r.join(of_one, one).withColumn("start", F.col("base") + F.col("inner")).drop("g", "base", "inner")


def plan(
    docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rid: Column | None = None
) -> DataFrame:
    """The mix as pieces: one row for each run of a document's words that a drawn block takes.

    rid, doc_id, size, source_size, target; shard, quota, pass, first_word and n_words (null where
    the document isn't drawn), and place, by which a shard's pieces are ordered.
    """
    rows = sizes(docs, id_col, source_col, text_col, rid)
    sources = durable(source_targets(rows, shards, blocks), "sources")
    drawn = durable(drawn_blocks(sources, shards), "drawn")
    r = streams(rows, sources)
    over = F.when(F.col("size") > 0, F.sequence(F.expr("((start + 1) * n_blocks - 1) div greatest(source_size, 1)"), F.expr("((start + size) * n_blocks - 1) div greatest(source_size, 1)"))).otherwise(F.array(F.lit(-1).cast("long")))
    r = r.select("rid", "doc_id", "size", "source_size", "target", "s", "start", "h", F.explode(over).alias("block"))
    r = r.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn, ["s", "block"], "left")
    a = F.greatest("start", "from_word")
    n = F.least(F.col("start") + F.col("size"), F.col("to_word")) - a
    r = r.withColumns({"first_word": a - F.col("start"), "n_words": n})
    got = F.col("shard").isNotNull() & (F.col("n_words") > 0)
    place = F.md5(F.concat_ws("|", F.lit("place"), "shard", "h", "pass", "block"))
    drawn_only = [F.when(got, F.col(c)).alias(c) for c in ("shard", "quota", "pass", "first_word", "n_words")]
    return r.select("rid", "doc_id", "size", "source_size", "target", *drawn_only, F.when(got, place).alias("place"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs, and drawn: its pieces as shard:quota:place:first_word:n_words, by pass and word."""
    piece = F.concat_ws(":", "shard", "quota", F.substring("place", 1, 8), "first_word", "n_words")
    pieces = plan(docs, **options).withColumn("piece", F.when(F.col("shard").isNotNull(), F.struct("pass", "first_word", piece.alias("piece"))))
    found = pieces.groupBy("rid", "doc_id", "size", "source_size", "target").agg(  # pieces of a document: one for each block and pass at most
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    return found.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("pieces", lambda p: p["piece"]), ",").alias("drawn"))


def identified(docs: DataFrame) -> DataFrame:
    """docs with RID, which tells its rows apart at every reading: file and row of a table of files; anything else is written first."""
    try:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(RID))
    except AnalysisException:
        return durable(docs.withColumn(RID, F.monotonically_increasing_id()), "identified")


def dealt(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: docs with SHARD and PLACE, a row for each time that a block with the document's first word is drawn.

    Documents stay whole, so a source's words come within a document of its target for each end of a
    drawn run. Rows come in ranges of shard and place, so a shard is read in its shuffled order.
    """
    known = identified(docs)
    pieces = plan(known, text_col=text_col, rid=F.col(RID), **options).where("first_word = 0")
    copies = pieces.select(F.col("rid").alias(RID), F.col("shard").alias(SHARD), F.concat("place", F.col("pass").cast("string")).alias(PLACE))
    got = known.join(copies, RID).select(*docs.columns, SHARD, PLACE)
    return got.repartitionByRange(parts(docs.sparkSession), SHARD, PLACE).sortWithinPartitions(SHARD, PLACE)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs: the whole documents of the mix, shard by shard, each in shuffled order."""
    return dealt(docs, **options).select(*docs.columns)


def write_mix(docs: DataFrame, path: str, name: str = "shard", **options) -> None:
    """The mix in folders, one a shard (name=0 and so on), each written by the tasks that hold its ranges."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    dealt(docs, **options).withColumnRenamed(SHARD, name).drop(PLACE).write.partitionBy(name).parquet(path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def _tree(levels: int) -> str:
    """The levels of the tree as common table expressions t0 to t{levels}."""
    out = ["n0 AS (SELECT s, k AS j, 0 AS node, row_number() OVER (ORDER BY md5(concat_ws('|', 'tree', s, k)), s, k) - 1 AS place, count(*) OVER () AS held FROM k)"]
    for i in range(levels):
        side = "(place >= (held + 1) // 2)"
        out.append(f"n{i + 1} AS (SELECT s, j, node * 2 + {side}::INTEGER AS node, CASE WHEN {side} THEN place - (held + 1) // 2 ELSE place END AS place, CASE WHEN {side} THEN held // 2 ELSE (held + 1) // 2 END AS held FROM n{i})")
    return ",\n".join(out)


LEVELS = SHARDS.bit_length() - 1
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, row_number() OVER () AS rid FROM documents),
dh AS (SELECT *, md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size)) AS h FROM d),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s
  FROM d GROUP BY source),
u AS (
  SELECT *, s % 3 + 1 AS weight, source_size * {REPEATS} AS cap, sum(source_size) OVER () AS total FROM w),
v AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit FROM u),
t AS (
  SELECT source, s, source_size, total, least(cap::DOUBLE, weight * max(unit) OVER ()) AS target FROM v),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest,
         CASE WHEN source_size > 0 THEN ceil(source_size / greatest(ceil(total / {SHARDS * BLOCKS}), 1))::BIGINT ELSE 0 END AS n_blocks FROM t),
b AS (
  SELECT s, whole, rest, i AS block, p AS pass, (i * source_size // n_blocks)::BIGINT AS from_word, ((i + 1) * source_size // n_blocks)::BIGINT AS to_word,
         md5(concat_ws('|', 'block', s, p, i)) AS mark
  FROM t2, unnest(range(0, n_blocks)) AS r(i), unnest(range(0, whole + 1)) AS q(p)),
x AS (
  SELECT *, CASE WHEN pass < whole THEN to_word - from_word ELSE
         rest - coalesce(sum(to_word - from_word) OVER (PARTITION BY s, pass ORDER BY mark, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS room FROM b),
k AS (
  SELECT s, block, pass, from_word, least(to_word, from_word + room)::BIGINT AS to_word,
         row_number() OVER (PARTITION BY s ORDER BY pass, mark, block) - 1 AS k FROM x WHERE room > 0),
{_tree(LEVELS)},
q AS (SELECT s, node AS shard, count(*) AS quota FROM n{LEVELS} GROUP BY s, node),
q2 AS (SELECT *, sum(quota) OVER (PARTITION BY s ORDER BY shard) AS upto FROM q),
drawn AS (SELECT k.*, q2.shard, q2.quota FROM k JOIN q2 ON q2.s = k.s AND k.k < q2.upto AND k.k >= q2.upto - q2.quota),
p AS (
  SELECT dh.doc_id, dh.rid, dh.size, dh.h, t2.s, t2.source_size, t2.target,
         coalesce(sum(dh.size) OVER (PARTITION BY t2.s ORDER BY dh.h, dh.doc_id, dh.size, dh.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM dh JOIN t2 ON dh.source IS NOT DISTINCT FROM t2.source),
m AS (
  SELECT p.*, x.shard, x.quota, x.pass, greatest(p.start, x.from_word) - p.start AS first_word,
         least(p.start + p.size, x.to_word) - greatest(p.start, x.from_word) AS n_words,
         substr(md5(concat_ws('|', 'place', x.shard, p.h, x.pass, x.block)), 1, 8) AS place
  FROM p LEFT JOIN drawn x ON x.s = p.s AND x.from_word < p.start + p.size AND x.to_word > p.start)
SELECT doc_id, size, source_size, target, coalesce(sum(n_words) FILTER (shard IS NOT NULL), 0)::BIGINT AS taken,
       coalesce(string_agg(concat_ws(':', shard, quota, place, first_word, n_words), ',' ORDER BY pass, first_word) FILTER (shard IS NOT NULL), '') AS drawn
FROM m GROUP BY doc_id, rid, size, source_size, target
"""
