"""The driver's contract, and DuckDB parity of every query that has SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return tuple(map(value, v))
    return repr(v)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op") or not n[2:3].isdigit()])
def test_query_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    relation = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(value(r[i]) for i in at) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["mmr_rerank", "fastrp_embedding", "negative_sampling", "random_edge_split", "pca_2d", "shortest_path_edges", "neighbour_mean", "neighbour_map"])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
