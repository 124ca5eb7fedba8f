"""Times without zone, handled without ever passing through a zone."""

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: datetime) -> Column:
    """A literal; a value with a zone is read as UTC."""
    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def month(time: Column | str) -> Column:
    return F.trunc(F.to_date(time), "month").cast("timestamp_ntz")


def day_number(time: Column | str) -> Column:
    return F.unix_date(F.to_date(time))


def hour_number(time: Column | str) -> Column:
    return day_number(time).cast("bigint") * 24 + F.hour(time)


def second_number(time: Column | str) -> Column:
    """Whole seconds since 1970, the fraction cut off."""
    return hour_number(time) * 3600 + F.minute(time) * 60 + F.second(time)
