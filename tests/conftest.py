import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    """Rows of SQL over the tables, as sorted lists of dictionaries' values."""
    import glob

    import duckdb

    base = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return base


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        columns = sorted(df.columns)
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        want = sorted((tuple(row[k] for k in order) for row in found.fetchall()), key=repr)
        got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
        assert got == want

    return check
