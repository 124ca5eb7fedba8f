"""Checks on how a bill is split between its participants."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import or_scattered
from pursebook.functions.money import settlement, total, unbalanced
from pursebook.functions.text import blank
from pursebook.operators.friends import friend_pairs
from pursebook.plans.ordered import id_block, with_earlier_totals
from pursebook.plans.skew import join_parent
from pursebook.schemas import TOTAL


def amount_row_checks(amounts: DataFrame) -> DataFrame:
    """Add `reason`, the first rule a row breaks on its own, or `ok`."""
    same = ["transaction_id", "account_id", "account_name"]
    repeated = (
        amounts.groupBy(*same)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1")
        .select(*[F.col(name).alias(f"_{name}") for name in same], "_rows")
    )
    twin = [amounts[name].eqNullSafe(repeated[f"_{name}"]) for name in same]
    reason = (
        F.when(F.col("account_id").isNull() & F.col("account_name").isNull(), "neither")
        .when(F.col("account_id").isNotNull() & F.col("account_name").isNotNull(), "both")
        .when(F.col("amount_to_pay") < 0, "negative_share")
        .when(F.col("amount_paid") < 0, "negative_payment")
        .when(F.col("_rows").isNotNull(), "repeated")
        .otherwise("ok")
    )
    return amounts.join(repeated, twin, "left").select(*amounts.columns, reason.alias("reason"))


def participants(
    transactions: DataFrame | None, amounts: DataFrame, accounts: DataFrame, friends: DataFrame, order: str = "id"
) -> DataFrame:
    """Amounts with the owner of the account and what that owner is to the creator.

    Amounts that carry their creator need no transactions. Guest rows and rows without a stranger's account have nothing to look up; their keys are
    scattered instead of left NULL.
    """
    row_id = ("transaction_id", order)
    if "creator_id" not in amounts.columns:
        creators = transactions.select(F.col("id").alias("transaction_id"), "creator_id")
        amounts = join_parent(amounts, creators, "transaction_id", order)
    owners = accounts.select(F.col("id").alias("_account"), F.col("user_id").alias("owner_id"))
    pairs = friend_pairs(friends).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias("_edge"))
    other = F.when(F.col("owner_id") != F.col("creator_id"), F.col("owner_id"))
    return (
        amounts.withColumn("_account", or_scattered(F.col("account_id"), *row_id))
        .join(owners, "_account", "left")
        .withColumn("is_own", F.coalesce(F.col("owner_id") == F.col("creator_id"), F.lit(False)))
        .withColumn("_lo", or_scattered(F.when(other.isNotNull(), F.least("creator_id", other)), *row_id))
        .withColumn("_hi", F.when(other.isNotNull(), F.greatest("creator_id", other)).otherwise(F.lit(0)))
        .join(pairs, ["_lo", "_hi"], "left")
        .withColumn("is_friend", F.coalesce(F.col("_edge"), F.lit(False)))
        .drop("_account", "_lo", "_hi", "_edge")
    )


def _row_reason() -> Column:
    no_account, no_name = F.col("account_id").isNull(), blank(F.col("account_name"))
    return (
        F.when(no_account & no_name, "neither")
        .when(~no_account & ~no_name, "both")
        .when(~no_account & F.col("owner_id").isNull(), "unknown_account")
        .when(~no_account & ~F.col("is_own") & ~F.col("is_friend"), "no_access")
    )


# Verdicts in the order they are looked for; the row reasons compete by place in the document.
ROW_REASONS = ("neither", "both", "unknown_account", "no_access")


def split_validation(
    transactions: DataFrame, amounts: DataFrame, accounts: DataFrame, friends: DataFrame, order: str = "id"
) -> DataFrame:
    """One verdict per transaction, the first failing check, with all failing checks as an array."""
    judged = split_verdicts(participants(transactions, amounts, accounts, friends, order), order)
    return (
        transactions.select(F.col("id").alias("transaction_id"))
        .join(judged, "transaction_id", "left")
        .select(
            "transaction_id",
            F.coalesce("verdict", F.lit("empty")).alias("verdict"),
            F.coalesce("reasons", F.array(F.lit("empty"))).alias("reasons"),
        )
    )


def split_verdicts(rows: DataFrame, order: str = "id", kept: tuple[str, ...] = ()) -> DataFrame:
    """Verdict and reasons of every transaction that has `participants` rows, with its `kept` values.

    Rows that carry whether their whole bill is `negative` and `unbalanced` need no amounts.
    """
    if "unbalanced" in rows.columns:
        money = [F.bool_or("negative").alias("_negative"), F.bool_or("unbalanced").alias("_gap")]
        gap = F.col("_gap")
    else:
        negative = (F.col("amount_paid") < 0) | (F.col("amount_to_pay") < 0)
        money = [total("amount_paid").alias("_paid"), total("amount_to_pay").alias("_to_pay"), F.bool_or(negative).alias("_negative")]
        gap = unbalanced(F.col("_paid"), F.col("_to_pay"))
    checked = rows.withColumn("_reason", _row_reason()).groupBy("transaction_id").agg(
        *money,
        F.bool_or("is_own").alias("_own"),
        F.min(F.when(F.col("_reason").isNotNull(), F.struct(order, "_reason"))).alias("_first"),
        *[F.bool_or(F.coalesce(F.col("_reason") == name, F.lit(False))).alias(f"_{name}") for name in ROW_REASONS],
        *[F.max(name).alias(name) for name in kept],
    )
    verdict = (
        F.when(F.col("_negative"), "negative")
        .when(F.col("_first").isNotNull(), F.col("_first._reason"))
        .when(gap, "unbalanced")
        .when(~F.col("_own"), "no_self")
        .otherwise("ok")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_negative"), "negative"),
            *[F.when(F.col(f"_{name}"), name) for name in ROW_REASONS],
            F.when(gap, "unbalanced"),
            F.when(~F.col("_own"), "no_self"),
        )
    )
    return checked.select("transaction_id", verdict.alias("verdict"), reasons.alias("reasons"), *kept)


def split_remaining(amounts: DataFrame, totals: DataFrame | None = None, order: str = "id") -> DataFrame:
    """What is left to allot before each participant, in entry order, and whether its share fits.

    The bill is the sum of the shares, or `totals(transaction_id, total)`. Every value must lie in
    0..remaining, and the last participant must take exactly the rest.
    """
    rows = amounts if totals is None else _with_bill(amounts, totals, order)
    bill = F.col("amount_to_pay") if totals is None else F.col("_bill")
    placed = with_earlier_totals(
        rows,
        ["transaction_id"],
        id_block(order),
        [F.asc(order)],
        {"_pay_before": F.col("amount_to_pay"), "_paid_before": F.col("amount_paid")},
        {"_total": (F.sum if totals is None else F.max, bill), "_last": (F.max, F.col(order))},
    )
    left_to_pay = (F.col("_total") - F.col("_pay_before")).cast(TOTAL)
    left_paid = (F.col("_total") - F.col("_paid_before")).cast(TOTAL)

    def fits(value: str, left: Column) -> Column:
        rest = F.when(F.col(order) == F.col("_last"), F.col(value) == left).otherwise(F.lit(True))
        return F.col(value).between(F.lit(0), left) & rest

    return placed.select(
        *amounts.columns,
        left_to_pay.alias("remaining_to_pay"),
        left_paid.alias("remaining_paid"),
        (fits("amount_to_pay", left_to_pay) & fits("amount_paid", left_paid)).alias("ok"),
    )


def _with_bill(amounts: DataFrame, totals: DataFrame, order: str) -> DataFrame:
    return amounts.join(totals.select("transaction_id", F.col("total").alias("_bill")), "transaction_id")


# Rules of the entry form, in the order they are listed.
ENTRY_RULES = (
    "no_participants",
    "no_amount",
    "first_not_own",
    "account_twice",
    "guest_without_name",
    "not_offered",
)


def split_participant_rules(
    transactions: DataFrame, amounts: DataFrame, accounts: DataFrame, friends: DataFrame, order: str = "id"
) -> DataFrame:
    """Which rules of the entry form a transaction breaks, as an array."""
    rows = participants(transactions, amounts, accounts, friends, order)
    per_account = rows.groupBy("transaction_id", "account_id").agg(
        F.count(F.lit(1)).alias("_uses"),
        total("amount_to_pay").alias("_to_pay"),
        F.min(F.struct(order, "is_own")).alias("_first"),
        F.bool_or(F.col("account_id").isNull() & blank(F.col("account_name"))).alias("_nameless"),
        F.bool_or(F.col("account_id").isNotNull() & ~F.col("is_own") & ~F.col("is_friend")).alias("_foreign"),
    )
    per_transaction = per_account.groupBy("transaction_id").agg(
        total("_to_pay").alias("_to_pay"),
        F.min("_first").alias("_first"),
        F.bool_or(F.col("account_id").isNotNull() & (F.col("_uses") > 1)).alias("account_twice"),
        F.bool_or("_nameless").alias("guest_without_name"),
        F.bool_or("_foreign").alias("not_offered"),
    )
    broken = {
        "no_participants": F.col("_first").isNull(),
        "no_amount": F.col("_to_pay") <= 0,
        "first_not_own": ~F.col("_first.is_own"),
        "account_twice": F.col("account_twice"),
        "guest_without_name": F.col("guest_without_name"),
        "not_offered": F.col("not_offered"),
    }
    return (
        transactions.select(F.col("id").alias("transaction_id"))
        .join(per_transaction, "transaction_id", "left")
        .select(
            "transaction_id",
            F.array_compact(F.array(*[F.when(broken[rule], rule) for rule in ENTRY_RULES])).alias("reasons"),
        )
    )


def settlement_status(amounts: DataFrame) -> DataFrame:
    """What each participant still owes, and the word for it."""
    to_pay, paid = F.col("amount_to_pay"), F.col("amount_paid")
    return amounts.select(
        "id",
        "transaction_id",
        (to_pay - paid).cast(TOTAL).alias("outstanding"),
        settlement(to_pay, paid).alias("status"),
    )
