"""Ledger tables as files: parquet tables with fixed schemas, JSON request bodies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pursebook import schemas

SCHEMAS = {
    "users": schemas.USERS,
    "accounts": schemas.ACCOUNTS,
    "transactions": schemas.TRANSACTIONS,
    "transaction_amounts": schemas.AMOUNTS,
    "transaction_tags": schemas.TAGS,
    "friends": schemas.FRIENDS,
    "friend_requests": schemas.FRIEND_REQUESTS,
}

# Tables with a time that searches and reports filter on.
BY_MONTH = ("transactions", "transaction_amounts")


def read_table(spark: SparkSession, folder: str, name: str, by_month: bool = False) -> DataFrame:
    """A table as `write_table` left it; `month` is kept as a column, which searches prune by."""
    schema = SCHEMAS[name]
    if by_month and name in BY_MONTH:
        schema = T.StructType([*schema.fields, T.StructField("month", T.StringType())])
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def write_table(rows: DataFrame, folder: str, name: str, by_month: bool = False) -> None:
    """Write a whole table as a new state; never over the one it was computed from.

    With `by_month` the large tables are laid out in month folders, so that a time range reads only
    its months. Rows are rebalanced to even files, and a month of any size is split over many.
    """
    columns = SCHEMAS[name].fieldNames()
    rows = rows.select(*columns)
    if by_month and name in BY_MONTH:
        rows = rows.withColumn("month", F.date_format("created_on", "yyyy-MM")).hint("rebalance", "month")
        rows.write.partitionBy("month").parquet(f"{folder}/{name}")
    else:
        rows.hint("rebalance").write.parquet(f"{folder}/{name}")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Create requests from JSON lines `{request_id, user_id, received_on, body}`, the body as text."""
    return spark.read.schema(schemas.REQUESTS).json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested transaction documents as JSON lines."""
    documents.write.json(path)
