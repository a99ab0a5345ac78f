import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame and a SQL relation have the same columns and rows, in any order."""
    import decimal

    def plain(v):
        v = float(v) if isinstance(v, decimal.Decimal) else v
        return round(v, 9) if isinstance(v, float) else v

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        at = [relation.columns.index(c) for c in names]
        got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
        want = [tuple(plain(r[i]) for i in at) for r in relation.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
