"""Roundings to the sign of zero, printed ties, and lines numbered over several files."""

import struct
import threading
import time

import duckdb
import numpy as np
import pytest

from lexiloom.plans import queries as own
from lexiloom.sources import interchange as io

TINY = [-1e-7, 1e-7, -4e-6, 1 / 128, -3 / 128, 0.0, -0.25, 0.5]


@pytest.fixture(scope="module")
def vectors_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(2)
    rows = [(i, [TINY[(i + k) % 8] if k < 16 else float(x) for k, x in enumerate(rng.normal(size=64))], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def bits(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(bits(x) for x in v)
    return struct.pack("<d", v) if isinstance(v, float) else v


def same_bits(spark, path, name):
    df = own.QUERIES[name](spark, path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({own.ORACLE_SQL[name]})").fetchall()
    assert sorted(bits(tuple(r)) for r in df.collect()) == sorted(bits(r) for r in want)


def test_emb_l2_normalize(spark, vectors_dir):
    same_bits(spark, vectors_dir, "emb_l2_normalize")


def test_emb_scale(spark, vectors_dir):
    same_bits(spark, vectors_dir, "emb_scale")


def test_emb_truncate(spark, vectors_dir):
    same_bits(spark, vectors_dir, "emb_truncate")


def test_matrix_text_format(spark, vectors_dir):
    same_bits(spark, vectors_dir, "matrix_text_format")


def test_printed_fields(spark):
    df = spark.createDataFrame([([0.0078125, -1e-7, float("nan"), None, float("inf")],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(io.vector_text(df.v)).collect()] == ["+0.007812 -0.000000 +nan +inf ", None]
    back = spark.createDataFrame([("+nan -0.5 x +inf",)], "t string")
    got = back.select(io.parse_vector(back.t)).first()[0]
    assert np.isnan(got[0]) and got[1:] == [-0.5, None, float("inf")]


def test_libsvm_text_roundtrip(spark, vectors_dir):
    same_bits(spark, vectors_dir, "libsvm_text_roundtrip")


def test_matrix_file_roundtrip(spark, vectors_dir):
    same_bits(spark, vectors_dir, "matrix_file_roundtrip")


def files(tmp_path, parts):
    """Files in this order, the later the larger: Spark reads large files first."""
    for i, lines in enumerate(parts):
        (tmp_path / f"part-{i:05d}-x-c000.txt").write_text("".join(f"{x}\n" for x in lines))
    return str(tmp_path)


PARTS = [range(3), range(3, 40), range(40, 2000)]


def test_matrix_rows_follow_the_files(spark, tmp_path):
    path = files(tmp_path, [[f"+{x}.000000 " for x in p] for p in PARTS])
    assert all(r.vec == [float(r.row_id)] for r in io.read_matrix(spark, path).collect())


def test_splits_of_a_file_and_late_parts(spark, tmp_path):
    path = files(tmp_path, [[f"+{x}.000000 " for x in p] for p in PARTS])
    (tmp_path / "part-100000-x-c000.txt").write_text("+2000.000000 \n")
    (tmp_path / "part-99999-x-c000.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = io.read_matrix(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2001 and all(r.vec == [float(r.row_id)] for r in got)


def test_sparse_file_roundtrip(spark, vectors_dir):
    same_bits(spark, vectors_dir, "sparse_file_roundtrip")


def test_sparse_rows_follow_the_files(spark, tmp_path):
    path = files(tmp_path, [[f"0:{x}.000000 3:1.000000" for x in p] for p in PARTS])
    rows, width = io.read_sparse(spark, path)
    assert width == 4 and all(r.val[0] == float(r.target_id) for r in rows.collect())


def test_vocabulary_ids_follow_the_files(spark, tmp_path):
    path = files(tmp_path, [[f"w{x} {5000 - x}" for x in p] for p in PARTS])
    got = io.read_vocab(spark, path).collect()
    assert len(got) == 2000 and all((r.word, r.freq) == (f"w{r.word_id}", 5000 - r.word_id) for r in got)


def test_vocabulary_ids_hold_when_splits_change(spark, tmp_path):
    """Executors that come or go change how files are dealt out to tasks; here the setting stands for them."""
    path = files(tmp_path, [[f"w{x} {5000 - x}" for x in p] for p in PARTS])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def change():
        while not spark.sparkContext.statusTracker().getActiveStageIds():
            time.sleep(0.001)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")

    other = threading.Thread(target=change)
    other.start()
    try:
        got = io.read_vocab(spark, path).collect()
    finally:
        other.join()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2000 and all((r.word, r.freq) == (f"w{r.word_id}", 5000 - r.word_id) for r in got)


@pytest.fixture(scope="module")
def marks_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("marks")
    texts = ["\ufeff \ufeff \ufeff \ufeffa \ufeff\ufeff b", "b \ufeffb c\ufeff \ufeff", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_vocab_file_roundtrip_keeps_byte_order_marks(spark, marks_dir):
    df = own.QUERIES["vocab_file_roundtrip"](spark, marks_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{marks_dir}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({own.ORACLE_SQL['vocab_file_roundtrip']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want


@pytest.mark.parametrize("gzip", [False, True])
def test_written_lines_keep_byte_order_marks(spark, tmp_path, gzip):
    lines = ["\ufeffa", "\ufeffa", "b", "\ufeff", "\ufeff\ufeff", "\ufeffc", None, "", "d\ufeff"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3).persist()
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        io.write_lines(df, str(tmp_path / "x"), gzip=gzip)
        io.write_lines(df.coalesce(1), str(tmp_path / "y"), gzip=gzip)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    for name in "xy":
        assert sorted(r.value for r in io.read_lines(spark, str(tmp_path / name)).collect()) == sorted(x or "" for x in lines)
