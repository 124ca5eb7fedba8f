"""Reports over the ledger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions.money import total
from pursebook.functions.text import same_tag
from pursebook.functions.times import month
from pursebook.plans.skew import join_grid, join_parent


def _reported(transactions: DataFrame, amounts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Payments of registered accounts in transactions that count for reports."""
    headers = transactions.where("include_in_reports").select(
        F.col("id").alias("transaction_id"),
        "category",
        "is_income",
        month("created_on").alias("month"),
    )
    owners = accounts.select(F.col("id").alias("account_id"), "user_id")
    paid = amounts.where(F.col("account_id").isNotNull()).select("transaction_id", "account_id", "amount_paid")
    return join_parent(paid, headers, "transaction_id", "account_id").join(owners, "account_id")


def report_category_month(transactions: DataFrame, amounts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Paid per user, month, category and direction."""
    return (
        _reported(transactions, amounts, accounts)
        .groupBy("user_id", "month", "category", "is_income")
        .agg(total("amount_paid").alias("paid"))
    )


def report_by_tag(transactions: DataFrame, amounts: DataFrame, accounts: DataFrame, tags: DataFrame) -> DataFrame:
    """Paid per user, month, tag and direction; a payment counts once for each different tag.

    Payments are summed per user and transaction first, so that a transaction meets its tags with
    one row per payer and not with every amount. Of a transaction with very many payers or tags, payers and tags meet in the
    cells of a grid, and are summed there first.
    """
    paid = (
        _reported(transactions, amounts, accounts)
        .groupBy("transaction_id", "user_id", "month", "is_income")
        .agg(total("amount_paid").alias("paid"))
    )
    different = tags.select("transaction_id", same_tag("tag").alias("tag")).distinct()
    return (
        join_grid(paid, different, "transaction_id", "user_id", "tag")
        .groupBy("user_id", "month", "tag", "is_income")
        .agg(total("paid").alias("paid"))
    )


def loan_positions(transactions: DataFrame, amounts: DataFrame) -> DataFrame:
    """Paid minus share per account, and per guest of a creator: above 0 lent, below 0 owed."""
    creators = transactions.select(F.col("id").alias("transaction_id"), "creator_id")
    guest = F.col("account_id").isNull()
    position = total(F.col("amount_paid") - F.col("amount_to_pay"))
    return (
        amounts.join(creators, "transaction_id")
        .groupBy(
            "account_id",
            F.when(guest, F.col("creator_id")).alias("guest_of"),
            F.when(guest, F.col("account_name")).alias("guest_name"),
        )
        .agg(position.alias("position"))
        .withColumn(
            "status",
            F.when(F.col("position") > 0, "loaned").when(F.col("position") < 0, "owed").otherwise("settled"),
        )
    )
