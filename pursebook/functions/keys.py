"""Join keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def low(a: Column | str, b: Column | str) -> Column:
    return F.least(a, b)


def high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(a, b)


def or_scattered(key: Column, *row_id: Column | str) -> Column:
    """`key`, or where it is NULL a negative value that differs from row to row.

    Ids are positive, so a scattered value finds no partner, just as NULL would not; but an outer
    join hashes all NULLs to one task, and guests (who have no account) can be a third of all rows.
    """
    return F.coalesce(key, -1 - F.pmod(F.xxhash64(*row_id), F.lit(1 << 48)))
