"""Text and binary interchange files. Ids are columns wherever a file's line number is one."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.operators.svd import Svd
from lexiloom.sources.tables import durable

#: A co-occurrence record: target id, context id (unsigned 32-bit), value (32-bit float), little-endian.
RECORD = np.dtype([("target_id", "<u4"), ("ctx_id", "<u4"), ("val", "<f4")])
#: The byte order mark, which readers skip at the start of a file.
MARK = "\ufeff"


# --- lines -------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(value): the lines of plain or gzipped text (by its .gz suffix); a last line needs no newline. header skips the first line of each file."""
    lines = spark.read.text(path)
    if not header:
        return lines
    # a file's first line is the one of its least place; splits are numbered in the order of a file
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = F.broadcast(placed.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_at")))  # a row for each file; lines keep their order
    return placed.join(first, ["_file", "_at"], "left_anti").select("value")


def read_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(doc_id, text), a document for each line. Gzipped files can't be split: give partitions to spread their lines."""
    lines = read_lines(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    return lines.repartition(partitions) if partitions else lines


def write_lines(df: DataFrame, path: str, column: str = "line", gzip: bool = False, mode: str = "errorifexists") -> None:
    """A line for each row, in the order of df. A file whose text begins with a byte order mark gets another one before it, which readers skip."""
    lines = df.select(F.col(column).alias("value"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    marked = F.when((F.col("_place") == 0) & F.startswith("value", F.lit(MARK)), F.concat(F.lit(MARK), "value")).otherwise(F.col("value"))
    # a file for each task, so that the first line of one is that of the other
    lines.select(marked.alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").option("maxRecordsPerFile", 0).text(path)


def is_gzip(head: bytes) -> bool:
    """Whether a file's first bytes are gzip's."""
    return head[:2] == b"\x1f\x8b"


def count_lines(spark: SparkSession, path: str, header: bool = False) -> int:
    return read_lines(spark, path, header).count()


def count_columns(spark: SparkSession, path: str, delimiter: str = " ") -> int:
    """Columns of the first line; 0 for an empty file."""
    first = read_lines(spark, path).first()
    return 0 if first is None else len(first.value.rstrip(delimiter + "\r").split(delimiter))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder; an error where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def readable(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unique_name(spark: SparkSession, path: str) -> str:
    """path, or path-1, path-2, ...: the first that isn't taken."""
    name, n = path, 0
    while readable(spark, name):
        n += 1
        name = f"{path}-{n}"
    return name


def check_not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def numbered(lines: DataFrame, name: str = "id") -> DataFrame:
    """Lines of read_lines with their number from 0 in reading order, counted in two levels: by file split, then within.

    Files follow one another by the number in part-N, then by path. A task reads splits in another order, by size.
    Lines are written once with their places: how files are split and dealt out changes with the executors at hand.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    split = durable(lines.select(*lines.columns, *place), "lines")
    sizes = split.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    part = F.regexp_extract("_file", "/part-([0-9]+)[^/]*$", 1).try_cast("long")
    order = Window.orderBy(part.asc_nulls_first(), "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_block", (F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_first")).alias("_start"))  # a row for each file split
    return split.join(F.broadcast(starts), ["_file", "_block"]).select(*lines.columns, (F.col("_start") + F.col("_at")).alias(name))


# --- vocabularies and word lists ---------------------------------------------------------------


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """(line): "word freq", most frequent first."""
    return vocab.orderBy(F.desc("freq"), "word").select(F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("line"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, word_id) of "word freq" lines; the id is the line's number."""
    lines = numbered(read_lines(spark, path), "word_id")
    part = F.split("value", " ")
    return lines.select(part[0].alias("word"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("freq"), F.col("word_id").cast("int").alias("word_id"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(id, word) of one word a line."""
    lines = numbered(read_lines(spark, path))
    return lines.select(F.col("id").cast("int").alias("id"), F.trim(F.replace("value", F.lit("\r"), F.lit(""))).alias("word"))


def write_words(words: DataFrame, path: str, id_col: str = "id") -> None:
    """One word a line, in the order of ids."""
    write_lines(words.orderBy(id_col).select(F.col("word").alias("line")), path)


# --- matrices ----------------------------------------------------------------------------------


def vector_text(vec: Column) -> Column:
    """Signed fields of six decimals, each followed by a blank: the exact binary value, rounded half to even, as C's printf does."""
    return _vector_text(vec)


@F.arrow_udf(StringType())
def _vector_text(vec: pa.Array) -> pa.Array:
    return pa.array([None if v is None else "".join("%+f " % x for x in v if x is not None) for v in vec.to_pylist()], pa.string())


def parse_vector(line: Column, dim: int | None = None) -> Column:
    """The numbers of a line, or its first dim ones."""
    v = F.transform(F.split(F.trim(line), "[ \t]+"), lambda x: F.regexp_replace(x, "^[+-]nan$", "nan").try_cast("double"))
    return F.slice(v, 1, dim) if dim else v


def read_matrix(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(row_id, vec) of a text matrix."""
    return numbered(read_lines(spark, path), "row_id").select("row_id", parse_vector(F.col("value"), dim).alias("vec"))


def write_matrix(matrix: DataFrame, path: str, id_col: str = "row_id", vector_col: str = "vec") -> None:
    write_lines(matrix.orderBy(id_col).select(vector_text(F.col(vector_col)).alias("line")), path)


def sparse_text(idx: Column, val: Column) -> Column:
    """"id:value" fields, ids from 0."""
    return F.array_join(F.zip_with(idx, val, lambda i, v: F.format_string("%d:%f", i, v)), " ")


def parse_sparse(line: Column) -> Column:
    """An array of (idx, val), ascending; of a repeated id the least value stays."""
    fields = F.filter(F.split(F.trim(line), "[ \t]+"), lambda x: x.contains(":"))
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("idx"), F.substring_index(x, ":", -1).cast("double").alias("val")))
    ordered = F.array_sort(pairs)
    return F.transform(F.array(ordered), lambda o: F.filter(o, lambda x, i: (i == 0) | (x["idx"] != F.get(o, i - 1)["idx"])))[0]


def ragged(matrix: DataFrame, vector_col: str = "vec") -> bool:
    """Whether rows differ in length."""
    return matrix.select(F.size(vector_col).alias("n")).distinct().limit(2).count() > 1


def read_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(target_id, idx, val) of a file of "id:value" lines, whose ids are line numbers, and its width, the greatest id plus one."""
    lines = numbered(read_lines(spark, path), "row")
    rows = lines.select(F.col("row").cast("int").alias("target_id"), parse_sparse(F.col("value")).alias("e"))
    rows = rows.select("target_id", F.transform("e", lambda x: x["idx"]).alias("idx"), F.transform("e", lambda x: x["val"]).alias("val"))
    return rows, (rows.agg(F.max(F.array_max("idx"))).first()[0] or -1) + 1


def _series(spark: SparkSession, values) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k int, value double")


def _dense(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(matrix)], "row_id int, vec array<double>")


def _read_dense(spark: SparkSession, path: str) -> np.ndarray:
    """A matrix of columns x rank, which the driver held when it was written."""
    return np.array([r.vec for r in spark.read.parquet(path).orderBy("row_id").collect()], float)


def _read_series(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.value for r in spark.read.parquet(path).orderBy("k").collect()], float)


def write_svd(svd: Svd, path: str) -> None:
    """Three tables under path: u (target_id, vec), s (k, value), v (row_id, vec)."""
    spark = svd.u.sparkSession
    svd.u.write.parquet(f"{path}/u")
    _series(spark, svd.s).write.parquet(f"{path}/s")
    _dense(spark, svd.v).write.parquet(f"{path}/v")


def read_svd(spark: SparkSession, path: str) -> Svd:
    """What write_svd wrote, for embeddings and folding in as separate steps."""
    return Svd(spark.read.parquet(f"{path}/u"), _read_series(spark, f"{path}/s"), _read_dense(spark, f"{path}/v"))


def write_components(scores: DataFrame, components: np.ndarray, path: str) -> None:
    """Two tables under path: scores (target_id, vec), components (row_id, vec)."""
    scores.write.parquet(f"{path}/scores")
    _dense(scores.sparkSession, components).write.parquet(f"{path}/components")


def read_components(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    return spark.read.parquet(f"{path}/scores"), _read_dense(spark, f"{path}/components")


def write_eigen(spark: SparkSession, values: np.ndarray, vectors: np.ndarray, path: str) -> None:
    """Two tables under path: values (k, value), vectors (row_id, vec)."""
    _series(spark, values).write.parquet(f"{path}/values")
    _dense(spark, vectors).write.parquet(f"{path}/vectors")


def read_eigen(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    return _read_series(spark, f"{path}/values"), _read_dense(spark, f"{path}/vectors")


# --- co-occurrence records ---------------------------------------------------------------------


def pack_records(cooc: DataFrame) -> DataFrame:
    """(seq, payload): the entries as 12-byte records, sorted by target and context, in blobs in that order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = np.empty(len(batch), RECORD)
            for name in RECORD.names:
                records[name] = batch[name]
            if len(batch):
                yield pd.DataFrame({"seq": [int(batch["seq"].iloc[0])], "payload": [records.tobytes()]})

    ordered = cooc.orderBy("target_id", "ctx_id").select(F.monotonically_increasing_id().alias("seq"), "target_id", "ctx_id", "val")
    return ordered.mapInPandas(run, "seq long, payload binary")


def unpack_records(blobs: DataFrame, column: str = "payload") -> DataFrame:
    """(target_id, ctx_id, val) of blobs of whole records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch[column]:
                if len(blob) % RECORD.itemsize:
                    raise ValueError("a torn record")
                r = np.frombuffer(blob, RECORD)
                yield pd.DataFrame({"target_id": r["target_id"].astype("int32"), "ctx_id": r["ctx_id"].astype("int32"), "val": r["val"].astype("float64")})

    return blobs.select(column).mapInPandas(run, "target_id int, ctx_id int, val double")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, ctx_id, val) of binary record files, each small enough for a task (write many, not one)."""
    return unpack_records(spark.read.format("binaryFile").load(path).select(F.col("content").alias("payload")))


def record(target_id: int, ctx_id: int, val: float) -> bytes:
    return struct.pack("<IIf", target_id, ctx_id, val)


# --- evaluation sets and options ---------------------------------------------------------------


def read_pairs(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, w1, w2, gold) of tab-separated lines, with either line end; malformed lines are dropped."""
    part = F.split(F.replace("value", F.lit("\r"), F.lit("")), "\t")
    rows = read_lines(spark, path).select(
        F.lit(dataset).alias("dataset"), F.get(part, F.lit(0)).alias("w1"), F.get(part, F.lit(1)).alias("w2"), F.get(part, F.lit(2)).try_cast("double").alias("gold")
    )
    return rows.where("gold is not null")


def read_questions(spark: SparkSession, path: str, category: str) -> DataFrame:
    """(category, a, b, c, d) of blank-separated lines."""
    part = F.split(F.trim(F.replace("value", F.lit("\r"), F.lit(""))), "[ \t]+")
    rows = read_lines(spark, path).select(F.lit(category).alias("category"), *[F.get(part, F.lit(i)).alias(c) for i, c in enumerate("abcd")])
    return rows.where("d is not null")


def options_table(spark: SparkSession, options: Mapping[str, object]) -> DataFrame:
    """(key, value) of a run's options."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(options.items())], "key string, value string")


def read_options(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of "key=value" lines; blank lines and comments (#) are skipped."""
    lines = read_lines(spark, path).where("trim(value) <> '' and not value like '#%'")
    return lines.select(F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("value"))


def write_options(options: DataFrame, path: str) -> None:
    write_lines(options.orderBy("key").select(F.concat_ws("=", "key", "value").alias("line")), path)
