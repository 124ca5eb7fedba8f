"""Edits and deletions of stored transactions.

An edit is one row of `transaction_patches` (at most one per transaction in a batch, but for
`edit_sequence`; NULL means "not given") and, where `replace_amounts` is set, the rows of `amount_patches` for it: the new list
of amounts. An edit is taken as a whole or refused as a whole.
"""

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.keys import or_scattered
from pursebook.functions.money import TOLERANCE, total, unbalanced
from pursebook.operators.balances import signed_images
from pursebook.operators.friends import friend_pairs
from pursebook.plans.skew import join_parent
from pursebook.schemas import MONEY

HEADER_FIELDS = ("category", "is_income", "include_in_reports", "description", "notes")
_TEXT_FIELDS = ("category", "description", "notes")


def apply_transaction_patches(transactions: DataFrame, patches: DataFrame) -> DataFrame:
    """Headers after the edits: a given field replaces the old value, an empty text does not."""

    def given(name: str) -> Column:
        return F.nullif(F.col(f"_{name}"), F.lit("")) if name in _TEXT_FIELDS else F.col(f"_{name}")

    changes = patches.select(
        F.col("transaction_id").alias("id"), *[F.col(name).alias(f"_{name}") for name in HEADER_FIELDS]
    )
    edited = transactions.join(changes, "id", "left")
    return edited.select(
        *[
            F.coalesce(given(name), F.col(name)).alias(name) if name in HEADER_FIELDS else name
            for name in transactions.columns
        ]
    )


def _has_header_fields() -> Column:
    given = F.lit(False)
    for name in HEADER_FIELDS:
        given = given | F.col(name).isNotNull()
    return given


def _merged_patches(amount_patches: DataFrame) -> DataFrame:
    """Patches of the same stored amount as one: of each field the last given value."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("position")))

    fields = ("account_id", "account_name", "amount_to_pay", "amount_paid")
    return (
        amount_patches.where(F.col("id").isNotNull())
        .groupBy("transaction_id", "id")
        .agg(*[last(name).alias(f"_{name}") for name in fields])
    )


def _replaced(patches: DataFrame) -> DataFrame:
    return patches.where("replace_amounts").select("transaction_id")


def apply_amount_patches(amounts: DataFrame, amount_patches: DataFrame, patches: DataFrame) -> DataFrame:
    """Amounts after the edits. Where a list is given it replaces the old one: rows it names are
    changed field by field, rows it does not name are gone, rows without id are new (their id stays
    NULL until they are stored)."""
    replaced = _replaced(patches).withColumn("_replaced", F.lit(True))
    merged = _merged_patches(amount_patches).withColumn("_named", F.lit(True))
    matched = amounts.join(merged, ["transaction_id", "id"], "left").join(replaced, "transaction_id", "left")
    kept = matched.where(F.col("_replaced").isNull() | F.col("_named")).select(
        "id",
        "transaction_id",
        *[
            F.coalesce(F.when(F.col("_replaced"), F.col(f"_{name}")), F.col(name)).alias(name)
            for name in ("account_id", "account_name", "amount_to_pay", "amount_paid")
        ],
        "created_on",
    )
    listed = amount_patches.where(F.col("id").isNull()).join(replaced, "transaction_id", "left_semi")
    new = listed.select(
        "id",
        "transaction_id",
        "account_id",
        "account_name",
        F.col("amount_to_pay").cast(MONEY).alias("amount_to_pay"),
        F.col("amount_paid").cast(MONEY).alias("amount_paid"),
        F.lit(None).cast("timestamp_ntz").alias("created_on"),
    )
    return kept.unionByName(new)


def amount_patch_rejects(
    amounts: DataFrame,
    amount_patches: DataFrame,
    patches: DataFrame,
    accounts: DataFrame,
    friends: DataFrame,
) -> DataFrame:
    """The amount patches that break a rule by themselves, with the first reason."""
    listed = amount_patches.join(
        patches.where("replace_amounts").select("transaction_id", "user_id"), "transaction_id"
    )
    stored = amounts.select("transaction_id", "id", F.lit(True).alias("_stored"))
    owners = accounts.select(F.col("id").alias("_account"), F.col("user_id").alias("_owner"))
    pairs = friend_pairs(friends).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias("_edge"))
    is_new, names_account = F.col("id").isNull(), F.col("account_id").isNotNull()
    names_guest = F.coalesce("account_name", F.lit("")) != ""
    reason = (
        F.when(F.col("account_id") <= 0, "bad_account_id")
        .when(F.col("account_name") == "", "empty_name")
        .when((F.col("amount_to_pay") < 0) | (F.col("amount_paid") < 0), "negative")
        .when(~is_new & F.col("_stored").isNull(), "foreign_id")
        .when(is_new & ~names_account & ~names_guest, "neither")
        .when(names_account & names_guest, "both")
        .when(names_account & F.col("_owner").isNull(), "unknown_account")
        .when(names_account & (F.col("_owner") != F.col("user_id")) & F.col("_edge").isNull(), "no_access")
        .when(is_new & F.col("amount_paid").isNull(), "no_amount_paid")
        .when(is_new & F.col("amount_to_pay").isNull(), "no_amount_to_pay")
    )
    return (
        listed.join(stored, ["transaction_id", "id"], "left")
        .withColumn("_account", or_scattered(F.col("account_id"), "transaction_id", "position"))
        .join(owners, "_account", "left")
        .withColumn("_lo", F.least("user_id", "_owner"))
        .withColumn("_hi", F.greatest("user_id", "_owner"))
        .join(pairs, ["_lo", "_hi"], "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("transaction_id", "position", "id", "reason")
    )


def post_edit_validation(amounts: DataFrame, patches: DataFrame) -> DataFrame:
    """Verdict on the new amounts of every transaction whose list was replaced."""
    both_or_none = F.col("account_id").isNull() == F.col("account_name").isNull()
    rows = join_parent(amounts, _replaced(patches), "transaction_id", "account_id", "account_name", how="left_semi")
    checked = (
        rows.groupBy("transaction_id", "account_id", "account_name")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            total("amount_paid").alias("_paid"),
            total("amount_to_pay").alias("_to_pay"),
        )
        .groupBy("transaction_id")
        .agg(
            total("_paid").alias("_paid"),
            total("_to_pay").alias("_to_pay"),
            F.bool_or(both_or_none).alias("_both_or_none"),
            F.bool_or(F.col("_rows") > 1).alias("_repeated"),
            F.bool_or(F.col("account_id").isNotNull()).alias("_registered"),
        )
    )
    verdict = (
        F.when(F.col("_both_or_none"), "either_or")
        .when(F.col("_repeated"), "repeated")
        .when(unbalanced(F.col("_paid"), F.col("_to_pay")), "unbalanced")
        .when(~F.col("_registered"), "no_account")
        .otherwise("ok")
    )
    return checked.select("transaction_id", verdict.alias("verdict"))


class Deletion(NamedTuple):
    transactions: DataFrame
    amounts: DataFrame
    tags: DataFrame
    reversal: DataFrame


def delete_transactions(
    transactions: DataFrame, amounts: DataFrame, tags: DataFrame, deleted: DataFrame
) -> Deletion:
    """Remove the transactions in `deleted(transaction_id)` with their children, and what that does to balances."""
    by_id = deleted.select(F.col("transaction_id").alias("id")).distinct()
    by_parent = deleted.select("transaction_id").distinct()
    taken_back = amounts.join(by_parent, "transaction_id", "left_semi").select(
        "transaction_id",
        F.col("account_id").alias("old_account_id"),
        F.col("amount_paid").alias("old_paid"),
        F.lit(None).cast("bigint").alias("new_account_id"),
        F.lit(None).cast(MONEY).alias("new_paid"),
    )
    return Deletion(
        transactions.join(by_id, "id", "left_anti").select(*transactions.columns),
        amounts.join(by_parent, "transaction_id", "left_anti").select(*amounts.columns),
        tags.join(by_parent, "transaction_id", "left_anti").select(*tags.columns),
        signed_images(taken_back, transactions).groupBy("account_id").agg(total("delta").alias("delta")),
    )


_AMOUNT_FIELDS = ("account_id", "account_name", "amount_to_pay", "amount_paid")


def _edited_rows(amounts: DataFrame, patches: DataFrame, amount_patches: DataFrame, accounts: DataFrame, friends: DataFrame) -> DataFrame:
    """Stored rows of the edited transactions and the rows listed for them, each with its edit, its account's owner and
    whether that is a friend. Rows of a large transaction are spread before they meet their edit."""
    columns = ("transaction_id", "id", "position", *_AMOUNT_FIELDS, "_stored")
    position = F.lit(None).cast(amount_patches.schema["position"].dataType)
    stored = amounts.withColumns({"position": position, "_stored": F.lit(True)}).select(*columns)
    listed = amount_patches.withColumn("_stored", F.lit(False)).select(*columns)
    edits = patches.select("transaction_id", "user_id", F.coalesce("replace_amounts", F.lit(False)).alias("_replaced"))
    rows = join_parent(stored.unionByName(listed), edits, "transaction_id", *_AMOUNT_FIELDS[:2], "id").where("_stored OR _replaced")
    return _with_owners(rows, accounts, friends, "transaction_id", "id", "position")


def _with_owners(rows: DataFrame, accounts: DataFrame, friends: DataFrame, *unique: str) -> DataFrame:
    """`rows` with the `_owner` of their account, and `_edge` where a listed row's owner is a friend of its editor."""
    owners = accounts.select(F.col("id").alias("_account"), F.col("user_id").alias("_owner"))
    pairs = friend_pairs(friends).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(True).alias("_edge"))
    asked = ~F.col("_stored") & (F.col("_owner") != F.col("user_id"))
    return (
        rows.withColumn("_account", or_scattered(F.col("account_id"), *unique))
        .join(owners, "_account", "left")
        .withColumn("_lo", or_scattered(F.when(asked, F.least("user_id", "_owner")), *unique))
        .withColumn("_hi", F.when(asked, F.greatest("user_id", "_owner")))
        .join(pairs, ["_lo", "_hi"], "left")
    )


def _reasons() -> tuple[Column, Column]:
    """What refuses a listed row: if it is new or names a stored amount, and if it names none of the transaction."""
    is_new = F.col("id").isNull()
    names_account = F.col("account_id").isNotNull()
    names_guest = F.coalesce("account_name", F.lit("")) != ""
    by_itself = (
        F.when(F.col("account_id") <= 0, "bad_account_id")
        .when(F.col("account_name") == "", "empty_name")
        .when((F.col("amount_to_pay") < 0) | (F.col("amount_paid") < 0), "negative")
    )
    by_lookup = (
        F.when(is_new & ~names_account & ~names_guest, "neither")
        .when(names_account & names_guest, "both")
        .when(names_account & F.col("_owner").isNull(), "unknown_account")
        .when(names_account & (F.col("_owner") != F.col("user_id")) & F.col("_edge").isNull(), "no_access")
        .when(is_new & F.col("amount_paid").isNull(), "no_amount_paid")
        .when(is_new & F.col("amount_to_pay").isNull(), "no_amount_to_pay")
    )
    return F.coalesce(by_itself, by_lookup), F.coalesce(by_itself, F.lit("foreign_id"))


def _post_image(rows: DataFrame) -> DataFrame:
    """One row per amount, before or after the edit: its fields after it, `_image` if it is there then, what refuses it and
    whether it shows the transaction to the editor."""
    stored, is_new = F.col("_stored"), F.col("id").isNull()
    known, foreign = _reasons()

    def first(reason: Column) -> Column:
        return F.min(F.when(~stored & reason.isNotNull(), F.struct("position", reason.alias("reason"))))

    def given(name: str) -> Column:
        return F.max_by(name, F.when(~stored & F.col(name).isNotNull(), F.col("position")))

    grouped = rows.groupBy("transaction_id", "id", F.when(is_new, F.col("position")).alias("_new")).agg(
        F.bool_or(stored).alias("_was"),
        F.bool_or(~stored).alias("_named"),
        F.bool_or("_replaced").alias("_replaced"),
        F.bool_or(stored & (F.col("_owner") == F.col("user_id"))).alias("_visible"),
        first(known).alias("_known"),
        first(foreign).alias("_foreign"),
        *[F.coalesce(given(name), F.max(F.when(stored, F.col(name)))).alias(name) for name in _AMOUNT_FIELDS],
    )
    there = F.col("_was") | is_new
    amount = {name: F.when(is_new, F.col(name).cast(MONEY)).otherwise(F.col(name)).alias(name) for name in _AMOUNT_FIELDS[2:]}
    return grouped.select(
        "transaction_id",
        *[amount.get(name, F.col(name)) for name in _AMOUNT_FIELDS],
        (F.col("_replaced") & F.col("_named") & there).alias("_image"),
        F.when(there, F.col("_known")).otherwise(F.col("_foreign")).alias("_reject"),
        "_visible",
    )


def edit_verdicts(
    amounts: DataFrame, patches: DataFrame, amount_patches: DataFrame, accounts: DataFrame, friends: DataFrame
) -> DataFrame:
    """What becomes of every edit: its first failing check, `deleted`, or `ok`.

    A replacement list without rows deletes the transaction, which header fields forbid. An edit of a transaction in which no
    account of the editor takes part is `not_found`. All checks are groupings over one image of the edited transactions, so
    the ledger's amounts and the lists meet their edits, accounts and friends once.
    """
    image = _post_image(_edited_rows(amounts, patches, amount_patches, accounts, friends))
    inside = F.col("_image")
    both_or_none = F.col("account_id").isNull() == F.col("account_name").isNull()
    checked = (
        image.groupBy("transaction_id", "account_id", "account_name")
        .agg(
            F.count_if(inside).alias("_rows"),
            total(F.when(inside, F.col("amount_paid"))).alias("_paid"),
            total(F.when(inside, F.col("amount_to_pay"))).alias("_to_pay"),
            F.min("_reject").alias("_reject"),
            F.bool_or("_visible").alias("_visible"),
        )
        .groupBy("transaction_id")
        .agg(
            F.sum("_rows").alias("_rows"),
            total("_paid").alias("_paid"),
            total("_to_pay").alias("_to_pay"),
            F.bool_or((F.col("_rows") > 0) & both_or_none).alias("_both_or_none"),
            F.bool_or(F.col("_rows") > 1).alias("_repeated"),
            F.bool_or((F.col("_rows") > 0) & F.col("account_id").isNotNull()).alias("_registered"),
            F.min("_reject")["reason"].alias("_reject"),
            F.bool_or("_visible").alias("_visible"),
        )
    )
    empty_text = F.lit(False)
    for name in _TEXT_FIELDS:
        empty_text = empty_text | (F.coalesce(F.col(name), F.lit("-")) == "")
    replaced = F.coalesce("replace_amounts", F.lit(False))
    emptied = replaced & (F.coalesce("_rows", F.lit(0)) == 0)
    verdict = (
        F.when(empty_text, "empty_field")
        .when(~F.coalesce("_visible", F.lit(False)), "not_found")
        .when(F.col("_reject").isNotNull(), F.col("_reject"))
        .when(emptied & _has_header_fields(), "delete_with_updates")
        .when(emptied, "deleted")
        .when(replaced & F.col("_both_or_none"), "either_or")
        .when(replaced & F.col("_repeated"), "repeated")
        .when(replaced & unbalanced(F.col("_paid"), F.col("_to_pay")), "unbalanced")
        .when(replaced & ~F.col("_registered"), "no_account")
        .otherwise("ok")
    )
    return patches.join(checked, "transaction_id", "left").select("transaction_id", verdict.alias("verdict"))


def edit_sequence(
    amounts: DataFrame, patches: DataFrame, amount_patches: DataFrame, accounts: DataFrame, friends: DataFrame
) -> DataFrame:
    """The verdict of each of several edits of a transaction, in the order of `seq`: (seq, transaction_id, verdict, n_amounts, paid).

    `patches` and `amount_patches` carry `seq`, which no two edits of a transaction share. Each edit is judged on the state
    that the accepted ones before it left; `n_amounts` and `paid` are of the state after it. Amounts that an edit adds have no id
    until they are stored, so later edits of the batch can't name them. Lookups and all checks of a row by itself are joins; what
    depends on the state is a fold over the rows sorted by (transaction, seq, position), which are streamed: a task holds one
    state and one edit's list, however many edits a transaction has.
    """
    position = F.lit(None).cast(amount_patches.schema["position"].dataType)
    nothing = {"seq": F.lit(None).cast("bigint"), "position": position, "user_id": F.lit(None).cast("bigint")}
    columns = ("transaction_id", "seq", "position", "user_id", "id", *_AMOUNT_FIELDS, "_stored")
    stored = amounts.join(patches.select("transaction_id").distinct(), "transaction_id", "left_semi").withColumns(nothing)
    lists = patches.where("replace_amounts").select("transaction_id", "seq", "user_id")
    listed = amount_patches.join(lists, ["transaction_id", "seq"]).withColumn("_stored", F.lit(False))
    rows = stored.withColumn("_stored", F.lit(True)).select(*columns).unionByName(listed.select(*columns))
    known, foreign = _reasons()
    rows = _with_owners(rows, accounts, friends, "transaction_id", "id", "seq", "position").select(
        "transaction_id", "seq", "position", "id", *_AMOUNT_FIELDS, F.col("_owner").alias("user_id"), known.alias("known"), foreign.alias("foreign")
    )
    empty_text = F.lit(False)
    for name in _TEXT_FIELDS:
        empty_text = empty_text | (F.coalesce(F.col(name), F.lit("-")) == "")
    headers = patches.select(
        "transaction_id",
        "seq",
        "user_id",
        F.coalesce("replace_amounts", F.lit(False)).alias("replaces"),
        empty_text.alias("empty"),
        _has_header_fields().alias("updates"),
    )
    events = rows.unionByName(headers, allowMissingColumns=True)
    placed = events.repartition("transaction_id").sortWithinPartitions("transaction_id", F.asc_nulls_first("seq"), F.desc_nulls_last("replaces"), "position")
    return placed.mapInArrow(_fold_edits, "seq long, transaction_id long, verdict string, n_amounts long, paid decimal(38,4)")


def _after_list(state: dict, listed: list[dict]) -> dict:
    """The amounts that a replacement list leaves: new ones, and named ones with the given fields changed."""
    after = {}
    for row in listed:
        key = row["id"] if row["id"] is not None else ("new", row["seq"], row["position"])
        old = after.get(key) or state.get(key) or dict.fromkeys((*_AMOUNT_FIELDS, "user_id"))
        new = {name: old[name] if row[name] is None else row[name] for name in _AMOUNT_FIELDS}
        after[key] = new | {"user_id": old["user_id"] if row["account_id"] is None else row["user_id"]}
    return after


def _step(state: dict, edit: dict, listed: list[dict]) -> tuple[str, dict]:
    """The verdict on an edit of a transaction in `state`, and the state after it."""
    if edit["empty"]:
        return "empty_field", state
    if edit["user_id"] is None or all(row["user_id"] != edit["user_id"] for row in state.values()):
        return "not_found", state
    if not edit["replaces"]:
        return "ok", state
    for row in listed:
        reason = row["known"] if row["id"] is None or row["id"] in state else row["foreign"]
        if reason:
            return reason, state
    after = _after_list(state, listed)
    if not after:
        return ("delete_with_updates", state) if edit["updates"] else ("deleted", after)
    payers = [(row["account_id"], row["account_name"]) for row in after.values()]
    gap = sum(row["amount_paid"] or 0 for row in after.values()) - sum(row["amount_to_pay"] or 0 for row in after.values())
    if any((account is None) == (name is None) for account, name in payers):
        return "either_or", state
    if len(set(payers)) < len(payers):
        return "repeated", state
    if abs(gap) >= Decimal(TOLERANCE):
        return "unbalanced", state
    if all(account is None for account, _ in payers):
        return "no_account", state
    return "ok", after


def _fold_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the edits in rows sorted by transaction: its stored amounts, then of each edit its header and its list."""
    schema = pa.schema(
        [("seq", pa.int64()), ("transaction_id", pa.int64()), ("verdict", pa.string()), ("n_amounts", pa.int64()), ("paid", pa.decimal128(38, 4))]
    )
    transaction, state, edit, listed, found = None, {}, None, [], []

    def close() -> None:
        nonlocal state, edit, listed
        if edit:
            verdict, state = _step(state, edit, listed)
            paid = sum((row["amount_paid"] or Decimal(0) for row in state.values()), Decimal(0))
            found.append({"seq": edit["seq"], "transaction_id": transaction, "verdict": verdict, "n_amounts": len(state), "paid": paid})
        edit, listed = None, []

    for batch in batches:
        for row in batch.to_pylist():
            if row["transaction_id"] != transaction or row["replaces"] is not None:
                close()
            if row["transaction_id"] != transaction:
                transaction, state = row["transaction_id"], {}
            if row["replaces"] is not None:
                edit = row
            elif row["seq"] is None:
                state[row["id"]] = row
            else:
                listed.append(row)
        yield pa.RecordBatch.from_pylist(found, schema)
        found.clear()
    close()
    yield pa.RecordBatch.from_pylist(found, schema)


class EditedLedger(NamedTuple):
    transactions: DataFrame
    amounts: DataFrame
    tags: DataFrame


def edited_ledger(
    transactions: DataFrame,
    amounts: DataFrame,
    tags: DataFrame,
    patches: DataFrame,
    amount_patches: DataFrame,
    verdicts: DataFrame,
) -> EditedLedger:
    """The ledger after the edits that passed; refused edits leave it as it was.

    `verdicts` is read several times: hand in a table that was written, not a plan.
    """
    accepted = patches.join(verdicts.where("verdict in ('ok', 'deleted')"), "transaction_id", "left_semi")
    deleted = verdicts.where("verdict = 'deleted'").select("transaction_id")
    headers = apply_transaction_patches(transactions, accepted)
    rows = apply_amount_patches(amounts, amount_patches, accepted)
    return EditedLedger(
        headers.join(deleted.select(F.col("transaction_id").alias("id")), "id", "left_anti").select(
            *transactions.columns
        ),
        rows,
        tags.join(deleted, "transaction_id", "left_anti").select(*tags.columns),
    )


def edit_deltas(
    before: DataFrame, after: DataFrame, old_headers: DataFrame, new_headers: DataFrame, touched: DataFrame
) -> DataFrame:
    """Balance change per account between two states of the `touched(transaction_id)` transactions.

    Header direction and amounts may change in one edit, so the signed rows of both states are
    compared, each with its own headers; rows that are the same in both cancel out.
    """
    touched = touched.select("transaction_id")

    def effect(rows: DataFrame, headers: DataFrame, sign: int) -> DataFrame:
        directions = headers.select(F.col("id").alias("transaction_id"), "is_income")
        paid = F.when(F.col("is_income"), F.col("amount_paid")).otherwise(-F.col("amount_paid"))
        return (
            rows.where(F.col("account_id").isNotNull())
            .select("transaction_id", "account_id", "amount_paid")
            .join(touched, "transaction_id", "left_semi")
            .join(directions, "transaction_id")
            .groupBy("account_id")
            .agg((total(paid) * F.lit(sign)).alias("delta"))
        )

    both = effect(before, old_headers, -1).unionByName(effect(after, new_headers, 1))
    summed = both.groupBy("account_id").agg(total("delta").alias("delta"))
    return summed.where(F.col("delta") != 0)
