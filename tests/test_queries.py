"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from lodestone.plans import vault_queries as V

DIR = os.environ.get("LODESTONE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "documents events labels pages conversations".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(V.SQL))
def test_same_rows(spark, other, name):
    got = V.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    found = other.execute(V.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_all_have_sql():
    assert set(V.QUERIES) - set(V.SQL) <= {"extract_article", "article_markdown", "article_assets", "page_sources"}
