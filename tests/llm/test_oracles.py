"""Registered queries against their SQL in DuckDB, over a table with nulls, empty texts and repeated texts."""

import duckdb
import pytest

from tessera.llm.queries import EXACT_MATCHES, ORACLES, QUERIES

SQL = ORACLES | {"op6_decontamination": EXACT_MATCHES}  # op6 has one column more, which test_near_items_by_brute_force covers


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The small tables, with odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, " \n"), (10_020, "one"), (10_040, "One"), (10_060, "one two three"), (10_080, "ONE two\tthree")], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).coalesce(3).write.parquet(f"{d}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.unionByName(spark.createDataFrame([(10_000, "u", None), (10_001, None, ""), (10_002, "w", "same"), (10_003, "w", "same")], "page_id long, url string, html string")).coalesce(2).write.parquet(f"{d}/pages.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("cast(item_id as string) as item_id", "text")
    items.union(spark.createDataFrame([("10000", "one"), ("10001", None), ("10002", "Two three")], items.schema)).coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, odd, name):
    with duckdb.connect() as c:
        for t in ("documents", "pages", "benchmark"):
            c.execute(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
        result = c.execute(SQL[name])
        names = [x[0] for x in result.description]
        want = sorted(map(repr, (tuple(dict(zip(names, x))[k] for k in sorted(names)) for x in result.fetchall())))
    df = QUERIES[name](spark, odd)
    assert sorted(df.columns) == sorted({*names, *(["n_near_items"] if name.startswith("op6") else [])})
    assert sorted(map(repr, (tuple(r[k] for k in sorted(names)) for r in df.collect()))) == want and want
