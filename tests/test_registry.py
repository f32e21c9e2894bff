"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import os

import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from lodestone.plans import landed  # noqa: F401  adds its queries
from lodestone.plans.registry import QUERIES, SQL
from lodestone.session import small_batches

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if x is None or x is pd.NA or x != x:
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def table(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["lang", "chunks", "words", "largest"] and out.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_queries_deal_small_batches_to_python(spark):
    """A batch of texts must not grow with a task's rows: every query sets it, before any plan of it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        driver.queries()["clean_text_docs"](spark, SF)
        sizes = spark.range(0, 2000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) == 500
    finally:
        small_batches(spark)


def test_queries_bound_the_bytes_of_batches(spark):
    """Nor with the length of its texts: 60 MB of texts of 200 KB each came as one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    try:
        driver.queries()["clean_text_docs"](spark, SF)
        long = spark.range(0, 300, 1, 1).selectExpr("repeat(char(97 + id % 26), 200000) AS text")
        sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) <= (8 << 20) + 200_100
    finally:
        small_batches(spark)
