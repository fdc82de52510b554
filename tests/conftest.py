import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    """A value as the comparison sees it."""
    import decimal

    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (float, decimal.Decimal)) else value


def same_rows(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    at = [relation.columns.index(c) for c in names]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert ours == theirs
