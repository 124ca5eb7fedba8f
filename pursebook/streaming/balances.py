"""Balances kept current from change feeds."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions.money import total
from pursebook.operators.balances import per_account, signed_images, turned_images
from pursebook.streaming.admission import admit, admitted, log_of
from pursebook.streaming.sink import write_batches

KEY = "change_id"


def _once(changes: DataFrame, key: str, delay: str) -> DataFrame:
    """Drop repeated deliveries. Changes later than `delay` behind the newest are dropped as well, unless the feed
    came through `admit`, which puts these aside; the keys of that span are the state."""
    timed = changes.withColumn("_time", F.col("changed_on").cast("timestamp")).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_time")


def stream_balance_changes(changes: DataFrame, delay: str) -> DataFrame:
    """Running balance change per account from a feed of amount changes.

    A change carries its direction (`is_income`), so it counts whether or not its transaction is
    stored yet. Sums commute, so the order of the feed does not matter; state is one sum per account
    and the change ids of the last `delay`.
    """
    return per_account(signed_images(_once(directed(changes), KEY, delay)))


def directed(changes: DataFrame) -> DataFrame:
    """The changes that can be booked. The others, without a direction, are `undirected`."""
    return changes.where(F.col("is_income").isNotNull())


def undirected(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("is_income").isNull())


def stream_direction_changes(turns: DataFrame, amounts: DataFrame, delay: str) -> DataFrame:
    """The same from a feed `(change_id, changed_on, transaction_id, was_income, is_income)`."""
    return per_account(turned_images(_once(turns, KEY, delay), amounts))


def run_balances(running: DataFrame, folder: str) -> DataFrame:
    """Run to the end of what is available; returns the latest sum of each account.

    Update mode writes only the accounts a batch touched.
    """
    query = write_batches(running, folder, "update")
    query.awaitTermination()
    written = running.sparkSession.read.parquet(f"{folder}/rows")
    return written.groupBy("account_id").agg(F.max_by("delta", "batch").alias("delta"))


def run_with_corrections(
    feed: DataFrame, folder: str, delay: str, running: Callable[[DataFrame], DataFrame], booked: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Book everything the feed has, in time or late; returns the sum of each account.

    `running` makes the streamed sums of the changes in time (`stream_balance_changes` or `stream_direction_changes`), `booked`
    the sums of a table of changes. Late ones are booked by a batch over all of them so far, once each, and not if they
    had come in time before: the log of what was admitted tells.
    """
    spark = feed.sparkSession
    admit(feed, "changed_on", delay, folder)
    stream = admitted(spark, feed.schema, folder)
    in_time = run_balances(running(stream), f"{folder}/in-time")
    late = late_changes(feed, folder)
    both = in_time.unionByName(booked(late).select("account_id", "delta"))
    return both.groupBy("account_id").agg(total("delta").alias("delta"))


def late_changes(feed: DataFrame, folder: str) -> DataFrame:
    """The changes that came behind the watermark and hadn't come before, one row each."""
    known = log_of(feed, folder, "admitted").select(KEY)
    return log_of(feed, folder, "late").dropDuplicates([KEY]).join(known, KEY, "left_anti").select(*feed.columns)
