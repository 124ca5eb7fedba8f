"""First come, first served inside a batch of requests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_first_claim(
    requests: DataFrame, keys: list[str], eligible: Column | None = None, order: str = "seq"
) -> DataFrame:
    """Mark with `is_first` the earliest (eligible) request of every key.

    The winner is a grouped minimum, combined before the shuffle, and finds its request by its
    unique `order`: a key that most of the requests fight over costs no more than any other.
    """
    winners = (requests if eligible is None else requests.where(eligible)).groupBy(*keys).agg(F.min(order).alias(order))
    return with_mark(requests, winners, "is_first", order)


def with_mark(requests: DataFrame, marked: DataFrame, name: str, order: str = "seq") -> DataFrame:
    """Add whether a request is among the `marked` ones."""
    marks = marked.select(order, F.lit(True).alias(name))
    return requests.join(marks, order, "left").withColumn(name, F.coalesce(name, F.lit(False)))
