"""Every core query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from sylva.operators.wide_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        answer = duck.sql(ORACLES[name])
        rows = [dict(zip(answer.columns, r, strict=True)) for r in answer.fetchall()]
        assert got == sorted((tuple(tidy(r[c]) for c in columns) for r in rows), key=repr)
