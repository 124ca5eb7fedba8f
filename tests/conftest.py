import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pursebook.session import local_session  # noqa: E402
from pursebook.sources.derive import Ledger  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "pursebook-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    return Ledger(spark, FOLDER)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture
def table(spark):
    """A small table from rows and a DDL schema."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
