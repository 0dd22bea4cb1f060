"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lexiloom.plans import queries as own


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_optional_folder():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "lexiloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexiloom.llm" not in p.read_text(), p
