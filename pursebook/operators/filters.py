"""Search filters as they come in a query string: texts, read and checked column by column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.operators.search import PAGE_LIMIT

_WHOLE = r"^\s*([+-]?[0-9]+)"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def _given(text: str) -> Column:
    return F.nullif(F.col(text), F.lit(""))


def whole_number(text: str) -> Column:
    """The whole number a text begins with, blanks before it aside; NULL if there is none."""
    return F.nullif(F.regexp_extract(_given(text), _WHOLE, 1), F.lit("")).try_cast("bigint")


def utc_time(text: str) -> Column:
    """An ISO date, or date and time with or without offset, as a time in UTC; NULL if it is none."""
    dated = F.when(_given(text).rlike(_DATE), _given(text))
    return dated.try_cast("timestamp").cast("timestamp_ntz")


def search_filters(texts: DataFrame) -> DataFrame:
    """`(seq, page, limit, start_date, end_date, category, account_id, tags)`, all text but seq and the array of tags.

    Empty texts count as not given; page and limit then are 1 and PAGE_LIMIT. `reason` names the
    first filter that can't be used: no_number, not_positive, no_date or empty_tag.
    """

    def number_fault(name: str) -> Column:
        return F.when(_given(name).isNotNull() & whole_number(name).isNull(), f"{name}:no_number").when(
            whole_number(name) <= 0, f"{name}:not_positive"
        )

    def date_fault(name: str) -> Column:
        return F.when(_given(name).isNotNull() & utc_time(name).isNull(), f"{name}:no_date")

    empty_tag = F.when(F.exists("tags", lambda tag: F.coalesce(tag, F.lit("")) == ""), "tags:empty_tag")
    faults = [number_fault("page"), number_fault("limit"), date_fault("start_date"), date_fault("end_date"), empty_tag]
    return texts.select(
        "seq",
        F.coalesce(whole_number("page"), F.lit(1)).alias("page_no"),
        F.coalesce(whole_number("limit"), F.lit(PAGE_LIMIT)).cast("bigint").alias("page_limit"),
        utc_time("start_date").alias("start_on"),
        utc_time("end_date").alias("end_on"),
        _given("category").alias("category"),
        whole_number("account_id").alias("account_id"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        F.coalesce(*faults, number_fault("account_id")).alias("reason"),
    )
