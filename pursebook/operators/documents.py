"""Transactions as documents, and the texts a client shows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import or_scattered
from pursebook.operators.friends import friend_pairs
from pursebook.operators.search import PAGE_LIMIT, transaction_page


def _nested(children: DataFrame, name: str) -> DataFrame:
    fields = [c for c in children.columns if c not in ("transaction_id", "id")]
    return children.groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias(name))


def transaction_documents(transactions: DataFrame, amounts: DataFrame, tags: DataFrame) -> DataFrame:
    """Headers with nested `amounts` and `tags`, both in id order: one row per transaction, whatever its size.

    A document is one row, so it holds its own children as arrays; what has to scale with a
    transaction's children works on the child tables instead. The inputs are nested apart, combined
    before the shuffle, and meet on the same key: each is shuffled once.
    """
    headers = transactions.select(
        F.col("id").alias("transaction_id"), *[c for c in transactions.columns if c != "id"]
    )
    nested_amounts = _nested(
        amounts.select("transaction_id", "id", "account_id", "account_name", "amount_to_pay", "amount_paid", "created_on"),
        "amounts",
    )
    nested_tags = _nested(tags.select("transaction_id", "id", "tag"), "tags")
    joined = headers.join(nested_amounts, "transaction_id", "left").join(nested_tags, "transaction_id", "left")
    return joined.withColumn("amounts", F.coalesce("amounts", F.array())).withColumn("tags", F.coalesce("tags", F.array()))


def transaction_list(
    found: DataFrame, transactions: DataFrame, amounts: DataFrame, tags: DataFrame, page: int = 1, limit: int = PAGE_LIMIT
) -> DataFrame:
    """One page of one user's search as documents, with `page`, `limit` and the `total` found.

    The page is cut first; its ids then pick the children. How they meet is left to Spark's size check.
    """
    ids = transaction_page(found, page, limit).select("id")
    by_parent = ids.select(F.col("id").alias("transaction_id"))
    filled = transaction_documents(
        transactions.join(ids, "id", "left_semi").select(*transactions.columns),
        amounts.join(by_parent, "transaction_id", "left_semi"),
        tags.join(by_parent, "transaction_id", "left_semi"),
    )
    return filled.select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        found.select(F.count(F.lit(1))).scalar().alias("total"),
        *filled.columns,
    )


def tag_list_text(tags: DataFrame) -> DataFrame:
    """The tags of a transaction joined with ", " in id order, one row per transaction."""
    nested = _nested(tags.select("transaction_id", "id", "tag"), "tags")
    return nested.select("transaction_id", F.concat_ws(", ", F.col("tags.tag")).alias("text"))


def amount_labels(
    views: DataFrame, amounts: DataFrame, accounts: DataFrame, users: DataFrame, friends: DataFrame
) -> DataFrame:
    """What `views(viewer_id, transaction_id)` shows for each amount.

    The label is the guest name or the account name, with the owner's user name. Names of accounts
    whose owner is neither the viewer nor a friend stay NULL.
    """
    row_id = ("viewer_id", "id")
    owned = accounts.join(
        users.select(F.col("id").alias("user_id"), F.col("username").alias("_owner_name")), "user_id", "left"
    ).select(F.col("id").alias("_account"), F.col("user_id").alias("_owner"), F.col("name").alias("_name"), "_owner_name")
    pairs = friend_pairs(friends).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias("_edge"))
    other: Column = F.when(F.col("_owner") != F.col("viewer_id"), F.col("_owner"))
    rows = (
        amounts.join(views.select("viewer_id", "transaction_id").distinct(), "transaction_id")
        .withColumn("_account", or_scattered(F.col("account_id"), *row_id))
        .join(owned, "_account", "left")
        .withColumn("_lo", or_scattered(F.when(other.isNotNull(), F.least("viewer_id", other)), *row_id))
        .withColumn("_hi", F.when(other.isNotNull(), F.greatest("viewer_id", other)).otherwise(F.lit(0)))
        .join(pairs, ["_lo", "_hi"], "left")
    )
    known = F.coalesce(F.col("_edge"), F.lit(False)) | (F.col("_owner") == F.col("viewer_id"))
    return rows.select(
        "viewer_id",
        "transaction_id",
        "id",
        F.coalesce("account_name", F.when(known, F.col("_name"))).alias("label"),
        F.when(known, F.col("_owner_name")).alias("owner_name"),
        "amount_paid",
        "amount_to_pay",
    )
