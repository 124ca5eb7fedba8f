"""Account balances, whole and by change."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions.money import signed, total
from pursebook.schemas import TOTAL


def _directions(transactions: DataFrame) -> DataFrame:
    return transactions.select(F.col("id").alias("transaction_id"), "is_income")


def account_balances(accounts: DataFrame, transactions: DataFrame, amounts: DataFrame) -> DataFrame:
    """Opening balance, plus income paid, minus expense paid, over every row of the account."""
    moved = (
        amounts.where(F.col("account_id").isNotNull())
        .select("transaction_id", "account_id", "amount_paid")
        .join(_directions(transactions), "transaction_id")
        .groupBy("account_id")
        .agg(total(signed("amount_paid", "is_income")).alias("_moved"))
    )
    balance = F.col("opening_balance") + F.coalesce("_moved", F.lit(0))
    return accounts.join(moved, accounts["id"] == moved["account_id"], "left").select(
        F.col("id").alias("account_id"), "user_id", balance.cast(TOTAL).alias("balance")
    )


def signed_images(changes: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """The old image of every changed amount taken back and the new one applied; also for streams.

    A change says itself whether it is income, as its trigger saw it; only where the column is
    missing is the transaction asked.
    """
    directed = changes if "is_income" in changes.columns else changes.join(_directions(transactions), "transaction_id")
    paid_back = F.struct(
        F.col("old_account_id").alias("account_id"), (-signed("old_paid", "is_income")).alias("delta")
    )
    paid = F.struct(F.col("new_account_id").alias("account_id"), signed("new_paid", "is_income").alias("delta"))
    return (
        directed.select(F.explode(F.array(paid_back, paid)).alias("image"))
        .select("image.account_id", "image.delta")
        .where(F.col("account_id").isNotNull())
    )


def turned_images(turns: DataFrame, amounts: DataFrame) -> DataFrame:
    """Effect of `(transaction_id, was_income, is_income)` on the accounts of the transaction; also for streams."""
    return (
        turns.where(F.col("was_income") != F.col("is_income"))
        .join(amounts.where(F.col("account_id").isNotNull()), "transaction_id")
        .select(
            "account_id",
            (signed("amount_paid", "is_income") - signed("amount_paid", "was_income")).alias("delta"),
        )
    )


def per_account(images: DataFrame) -> DataFrame:
    return images.groupBy("account_id").agg(total("delta").alias("delta"))


def balance_delta_from_changes(changes: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Balance change per account from inserted, updated and deleted amount rows."""
    return per_account(signed_images(changes, transactions))


def balance_delta_from_direction_change(before: DataFrame, after: DataFrame, amounts: DataFrame) -> DataFrame:
    """Balance change per account from transactions that turned from income to expense or back."""
    turns = _directions(before).withColumnRenamed("is_income", "was_income").join(_directions(after), "transaction_id")
    return per_account(turned_images(turns, amounts))


def refresh_balances(balances: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Add the deltas to the balances they touch."""
    summed = deltas[0]
    for delta in deltas[1:]:
        summed = summed.unionByName(delta)
    summed = per_account(summed)
    return balances.join(summed, "account_id", "left").select(
        "account_id",
        "user_id",
        (F.col("balance") + F.coalesce("delta", F.lit(0))).cast(TOTAL).alias("balance"),
    )


def total_balance(balances: DataFrame) -> DataFrame:
    return balances.groupBy("user_id").agg(total("balance").alias("total"))
