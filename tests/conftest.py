import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from opinara.session import local_session

    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = local_session("tests", cores="8", memory="12g", scratch=scratch)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in sorted(f[:-8] for f in os.listdir(data) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.fixture
def one(spark):
    """Value of a column function on one string, or on several."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        rows = df.select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()
        got = [r["r"] for r in rows]
        return got if len(values) > 1 else got[0]

    return run
