"""Create requests as a stream: accepted ledger rows and a quarantine."""

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pursebook.operators.requests import flatten_requests, shaped_amounts
from pursebook.operators.splits import participants, split_verdicts
from pursebook.streaming.sink import write_batches


def request_verdicts(requests: DataFrame, accounts: DataFrame, friends: DataFrame) -> DataFrame:
    """Verdict per request: first its shape, then how the bill is split."""
    rows = participants(None, shaped_amounts(requests), accounts, friends, order="slot")
    judged = split_verdicts(rows, order="slot", kept=("shape",))
    return judged.select("transaction_id", F.coalesce("shape", "verdict").alias("verdict"))


class Accepted(NamedTuple):
    """What has been published so far."""

    verdicts: DataFrame
    headers: DataFrame
    amounts: DataFrame
    tags: DataFrame
    quarantine: DataFrame


def run_split_validation(requests: DataFrame, accounts: DataFrame, friends: DataFrame, folder: str) -> Accepted:
    """Check a stream of requests as it comes in; what is accepted appears as a whole or not at all.

    A request is one row, so no state is kept. A batch is written as one nested table, a row for each request with its verdict
    and, where it is accepted, its whole document; then the batch is published by one more row. `published` shows only
    the requests of published batches, so headers, amounts and tags of a request are never seen without each other.
    """

    def outputs(batch: DataFrame, batch_id: int) -> Iterator[tuple[str, DataFrame]]:
        verdicts = request_verdicts(batch, accounts, friends).withColumnRenamed("transaction_id", "request_id")
        yield "requests", batch.join(verdicts, "request_id")
        yield "published", _publication(batch, batch_id)

    write_batches(requests, folder, "append", outputs).awaitTermination()
    return published(requests, folder)


def _publication(batch: DataFrame, batch_id: int) -> DataFrame:
    return batch.sparkSession.range(1).select(F.lit(batch_id).alias("id"))


def published(requests: DataFrame, folder: str) -> Accepted:
    """The five tables of the batches that were published, split from the nested rows on reading."""
    spark = requests.sparkSession
    rows = T.StructType([*requests.schema.fields, T.StructField("verdict", T.StringType()), T.StructField("batch", T.IntegerType())])
    done = spark.read.schema("id int, batch int").parquet(f"{folder}/published").select("batch")
    known = spark.read.schema(rows).parquet(f"{folder}/requests").join(done, "batch", "left_semi").drop("batch")
    flat = flatten_requests(known.where("verdict = 'ok'"))
    return Accepted(
        known.select(F.col("request_id").alias("transaction_id"), "verdict"),
        flat.headers.drop("shape"),
        flat.amounts,
        flat.tags,
        known.where("verdict <> 'ok'"),
    )
