"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tessera.plans import write_queries  # noqa: F401 - registers its queries
from tessera.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    expected = sorted(tuple(plain(dict(zip(names, x))[c]) for c in columns) for x in result.fetchall())
    assert sorted(names) == columns
    assert rows == expected


def test_extract_links_of_urls_with_brackets(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(1, "https://a.org/x_(y)"), (2, "https://a.org/b")], "page_id long, url string").coalesce(1).write.parquet(path)
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{path}/*.parquet'")
        expected = sorted(c.execute(ORACLES["extract_links"]).fetchall())
    assert len(expected) == 3 and sorted(map(tuple, QUERIES["extract_links"](spark, str(tmp_path)).collect())) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["belief_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
