"""Accounts: listing, masking, opening, renaming and closing."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import or_scattered
from pursebook.functions.text import blank
from pursebook.operators.friends import are_friends, both_directions
from pursebook.plans.claims import with_first_claim
from pursebook.plans.ordered import newest_first
from pursebook.schemas import MONEY


def accounts_by_user(accounts: DataFrame, user_id: int | None = None) -> DataFrame:
    """Newest first: a sorted list for one user, the place of each account for everybody."""
    if user_id is not None:
        return accounts.where(F.col("user_id") == user_id).orderBy(F.desc("created_on"), F.desc("id"))
    return newest_first(accounts, "user_id", "id")


def _masked(rows: DataFrame) -> DataFrame:
    """Balance and time of another user's account are hidden from the viewer."""
    own = F.col("owner_id") == F.col("viewer_id")
    return rows.select(
        "viewer_id",
        "account_id",
        "owner_id",
        "name",
        F.when(own, F.col("balance")).alias("balance"),
        F.when(own, F.col("created_on")).alias("created_on"),
        (~own).alias("is_masked"),
    )


def _owned(accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Account rows with their derived balance."""
    return accounts.select(
        F.col("id").alias("account_id"), F.col("user_id").alias("owner_id"), "name", "created_on"
    ).join(balances.select("account_id", "balance"), "account_id")


def visible_accounts(
    requests: DataFrame, accounts: DataFrame, balances: DataFrame, friends: DataFrame
) -> DataFrame:
    """The accounts of `requests(viewer_id, account_id)` that the viewer or a friend owns, masked."""
    asked = requests.distinct().join(_owned(accounts, balances), "account_id")
    judged = are_friends(
        asked.withColumn("user_id", F.col("viewer_id")).withColumn("other_id", F.col("owner_id")), friends
    )
    return _masked(judged.where(F.col("friends") | (F.col("owner_id") == F.col("viewer_id"))))


def accounts_visible_to(
    viewer_id: int, accounts: DataFrame, balances: DataFrame, friends: DataFrame
) -> DataFrame:
    """All accounts one viewer may see: one semi join against own id and friends, no OR."""
    touching = friends.where((F.col("user_id") == viewer_id) | (F.col("friend_id") == viewer_id))
    reach = both_directions(touching).where(F.col("user_id") == viewer_id).select(F.col("friend_id").alias("owner_id"))
    reach = reach.unionByName(accounts.where(F.col("user_id") == viewer_id).select(F.col("user_id").alias("owner_id")))
    seen = _owned(accounts, balances).join(reach, "owner_id", "left_semi")
    return _masked(seen.withColumn("viewer_id", F.lit(viewer_id).cast("bigint")))


class FriendAccounts(NamedTuple):
    verdicts: DataFrame
    accounts: DataFrame


def friend_accounts(
    requests: DataFrame, users: DataFrame, accounts: DataFrame, friends: DataFrame
) -> FriendAccounts:
    """Accounts without balance of the friends asked for in `requests(viewer_id, friend_id)`, newest first."""
    asked = requests.select("viewer_id", "friend_id").distinct()
    judged = are_friends(
        asked.withColumn("user_id", F.col("viewer_id")).withColumn("other_id", F.col("friend_id")), friends
    ).join(users.select(F.col("id").alias("friend_id"), "username"), "friend_id", "left")
    verdict = F.when(~F.col("friends"), "not_friends").when(F.col("username").isNull(), "not_found").otherwise("ok")
    verdicts = judged.select("viewer_id", "friend_id", "username", verdict.alias("verdict"))
    placed = newest_first(accounts, "user_id", "id").select(
        F.col("user_id").alias("friend_id"), F.col("id").alias("account_id"), "name", "created_on", "position"
    )
    listed = (
        verdicts.where("verdict = 'ok'")
        .join(placed, "friend_id")
        .select("viewer_id", "friend_id", "username", "account_id", "name", "created_on", "position")
    )
    return FriendAccounts(verdicts, listed)


class AccountChange(NamedTuple):
    verdicts: DataFrame
    accounts: DataFrame


def open_accounts(requests: DataFrame, accounts: DataFrame, users: DataFrame) -> AccountChange:
    """Serve `(seq, opened_on, user_id, name, initial_balance)`; the balance defaults to 0 and may be negative."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    verdict = (
        F.when(F.coalesce(F.col("user_id"), F.lit(0)) <= 0, "bad_user_id")
        .when(blank(F.col("name")), "empty_name")
        .when(F.col("_known").isNull(), "unknown_user")
        .otherwise("opened")
    )
    judged = requests.join(known, "user_id", "left").withColumn("verdict", verdict)
    last = accounts.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    opened = judged.where("verdict = 'opened'").select(
        (last + F.col("seq")).alias("id"),
        "user_id",
        "name",
        F.coalesce("initial_balance", F.lit(0)).cast(MONEY).alias("opening_balance"),
        F.col("opened_on").alias("created_on"),
    )
    return AccountChange(judged.select("seq", "user_id", "name", "verdict"), accounts.unionByName(opened))


def rename_accounts(accounts: DataFrame, renames: DataFrame) -> AccountChange:
    """Serve `(seq, user_id, account_id, name)` for owners; the last accepted name stays."""
    owned = accounts.select(F.col("id").alias("account_id"), "user_id", F.lit(True).alias("_owned"))
    verdict = (
        F.when(blank(F.col("name")), "empty_name").when(F.col("_owned").isNull(), "not_found").otherwise("renamed")
    )
    verdicts = renames.join(owned, ["account_id", "user_id"], "left").select(
        "seq", "user_id", "account_id", "name", verdict.alias("verdict")
    )
    latest = (
        verdicts.where("verdict = 'renamed'")
        .groupBy(F.col("account_id").alias("id"))
        .agg(F.max_by("name", "seq").alias("_name"))
    )
    renamed = accounts.join(latest, "id", "left").withColumn("name", F.coalesce("_name", "name"))
    return AccountChange(verdicts, renamed.select(*accounts.columns))


class Closure(NamedTuple):
    verdicts: DataFrame
    accounts: DataFrame
    amounts: DataFrame


def guests_instead(amounts: DataFrame, closed: DataFrame) -> DataFrame:
    """Amounts of closed accounts become guest rows that carry the account's old name."""
    names = closed.select(F.col("id").alias("_closed"), F.col("name").alias("_name"))
    key = or_scattered(F.col("account_id"), "id")
    rows = amounts.withColumn("_key", key).join(names, F.col("_key") == F.col("_closed"), "left")
    was_closed = F.col("_closed").isNotNull()
    return rows.withColumn("account_name", F.when(was_closed, F.col("_name")).otherwise(F.col("account_name"))).withColumn(
        "account_id", F.when(~was_closed, F.col("account_id"))
    ).select(*amounts.columns)


def delete_accounts(accounts: DataFrame, amounts: DataFrame, deletions: DataFrame) -> Closure:
    """Serve `(seq, user_id, account_id)` for owners."""
    owned = accounts.select(F.col("id").alias("account_id"), "user_id", F.lit(True).alias("_owned"))
    known = deletions.join(owned, ["account_id", "user_id"], "left")
    judged = with_first_claim(known, ["account_id"], F.col("_owned").isNotNull())
    verdicts = judged.select(
        "seq", "user_id", "account_id", F.when(F.col("is_first"), "deleted").otherwise("not_found").alias("verdict")
    )
    gone = verdicts.where("verdict = 'deleted'").select(F.col("account_id").alias("id"))
    return Closure(
        verdicts,
        accounts.join(gone, "id", "left_anti").select(*accounts.columns),
        guests_instead(amounts, accounts.join(gone, "id", "left_semi")),
    )


def account_by_id(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for `ids(account_id)` with owner and name, and whether each was found."""
    known = accounts.select(F.col("id").alias("account_id"), "user_id", "name", F.lit(True).alias("_known"))
    return (
        ids.select("account_id")
        .distinct()
        .join(known, "account_id", "left")
        .select("account_id", "user_id", "name", F.coalesce("_known", F.lit(False)).alias("found"))
    )
