import os
import sys
import tempfile

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallyloom.session import local_session  # noqa: E402
from tallyloom.sources.tables import SampleTables  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LANDING = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    return local_session(8, work=tempfile.mkdtemp(prefix="tallyloom-tests-"))


@pytest.fixture(scope="session")
def tables(spark):
    return SampleTables(spark, DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in LANDING:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


class Tables:
    """Hand-made tables: attribute access to DataFrames."""

    def __init__(self, spark, **frames):
        self.spark = spark
        self.__dict__.update(frames)

    def table(self, name):
        return getattr(self, name)


@pytest.fixture
def make(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def bundle(spark):
    return lambda **frames: Tables(spark, **frames)
