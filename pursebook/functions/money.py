"""Exact money arithmetic: DECIMAL(19,4) values, DECIMAL(38,4) totals."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pursebook.schemas import TOTAL

# Fixed value: sums that differ by this much or more do not balance.
TOLERANCE = "0.01"


def total(value: Column | str) -> Column:
    return F.sum(value).cast(TOTAL)


def signed(paid: Column | str, is_income: Column | str) -> Column:
    """What a payment does to the balance of the account that made it."""
    paid = F.col(paid) if isinstance(paid, str) else paid
    return F.when(F.col(is_income) if isinstance(is_income, str) else is_income, paid).otherwise(-paid)


def unbalanced(paid: Column, to_pay: Column) -> Column:
    return F.abs(paid - to_pay) >= F.lit(TOLERANCE).cast("decimal(19,4)")


def settlement(to_pay: Column, paid: Column) -> Column:
    return F.when(paid > to_pay, "loaned").when(paid < to_pay, "owed").otherwise("settled")
