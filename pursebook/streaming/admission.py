"""The gate before stateful streams: rows of a feed behind its watermark go to a table of their own instead of being lost."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pursebook.streaming.sink import batch_folder, write_batches


def admit(feed: DataFrame, time: str, delay: str, folder: str) -> None:
    """Take in what is available: rows in time go to `admitted`, those `delay` or more behind the newest one before to `late`.

    A batch is judged by the newest time of the batches before it, so which rows are late depends on the order of delivery
    alone. A stream over `admitted` with the same delay finds none of them late if it takes whole batches in their order: inside a
    batch rows are in no order, so one that stopped within a batch would move its watermark past the rest and lose it.
    A row without time is late. Every batch overwrites its own folders; one broken off and repeated after a reader
    has seen it is delivered twice, which readers have to stand anyway.
    """

    def outputs(batch: DataFrame, batch_id: int) -> Iterator[tuple[str, DataFrame]]:
        progress = T.StructType([T.StructField("newest", batch.schema[time].dataType)])
        spark = batch.sparkSession
        if batch_id:
            before = spark.read.schema(progress).parquet(batch_folder(folder, "progress", batch_id - 1)).first()["newest"]
        else:
            before = None
        newest = F.lit(before).cast(progress["newest"].dataType)
        in_time = F.coalesce(F.col(time) > newest - F.expr(f"INTERVAL {delay}"), F.col(time).isNotNull() & newest.isNull())
        yield "admitted", batch.where(in_time)
        yield "late", batch.where(~in_time)
        yield "progress", batch.agg(F.greatest(F.max(time), newest).alias("newest"))

    write_batches(feed, folder, "append", outputs).awaitTermination()


def admitted(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    """The rows in time, as a stream. All batches that are there are one micro-batch: a limit on files or bytes would cut a batch."""
    return spark.readStream.schema(schema).parquet(f"{folder}/admitted").select(*schema.fieldNames())


def log_of(feed: DataFrame, folder: str, name: str) -> DataFrame:
    """All rows of `admitted` or `late` so far, as a table."""
    return feed.sparkSession.read.schema(feed.schema).parquet(f"{folder}/{name}").select(*feed.columns)
