import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def same(spark, data):
    """Whether a query gives the same rows as its SQL."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")

    def plain(v):
        return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
        r = con.sql(sql)
        assert sorted(r.columns) == names
        at = [r.columns.index(c) for c in names]
        theirs = sorted((tuple(plain(x[k]) for k in at) for x in r.fetchall()), key=str)
        assert mine == theirs

    return check
