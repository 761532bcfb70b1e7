import math

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    frame = catalog.queries()[name](spark, sf_dir)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(relation.columns, relation.fetchall())
