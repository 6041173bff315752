"""Each query of the engine against its DuckDB counterpart."""

import math

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: ("nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v)
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_duckdb(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found.collect(), found.columns) == canonical(expected.fetchall(), expected.columns)


def test_shard_files_of_many_sizes(spark, tmp_path):
    spark.range(1, 3001).selectExpr("cast(id as int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalogue.QUERIES["shard_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(catalogue.ORACLES["shard_files"]).fetchall()) and len(got) == 3000
