"""Create requests: one JSON document per row, flattened into ledger rows."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.money import unbalanced
from pursebook.functions.text import blank
from pursebook.schemas import MONEY, TOTAL


class FlatRequests(NamedTuple):
    headers: DataFrame
    amounts: DataFrame
    tags: DataFrame


def flatten_requests(requests: DataFrame) -> FlatRequests:
    """`(request_id, user_id, received_on, body)` -> transaction headers, amounts and tags.

    A body that is no JSON, or has a field of the wrong type, is refused as a whole: its header has
    the `shape` not_json or bad_type and no content. No value is coerced: a number is taken exactly, however it is
    written, and one that its column can't hold is too_large or too_precise (more than four decimals).
    is_income defaults to false, include_in_reports to true, blank notes count as absent. Amounts
    and tags keep their place in the document as `slot`, and amounts carry the creator, so that
    checking them needs no join back to the header.
    """
    parsed = _parsed(requests)
    headers = parsed.select(
        F.col("transaction_id").alias("id"),
        "creator_id",
        F.col("doc.category").alias("category"),
        F.coalesce("doc.isIncome", F.lit(False)).alias("is_income"),
        F.coalesce("doc.includeInReports", F.lit(True)).alias("include_in_reports"),
        F.col("doc.description").alias("description"),
        F.nullif(F.col("doc.notes"), F.lit("")).alias("notes"),
        "created_on",
        _shape_reason().alias("shape"),
    )
    amounts = _exploded(parsed, ["transaction_id", "creator_id", "created_on"], "doc.amounts", "_amount")
    tags = _exploded(parsed, ["transaction_id"], "doc.tags", "tag")
    return FlatRequests(
        headers,
        amounts.select("transaction_id", "creator_id", *_amount_columns(), "created_on"),
        tags.select("transaction_id", (F.col("_at") + 1).cast("bigint").alias("slot"), "tag"),
    )


def _exploded(parsed: DataFrame, kept: list[str], items: str, name: str) -> DataFrame:
    """One row per item. An inner explode would add a filter on the items, which is pushed below the parse and repeats it
    for each field it names; so all rows are exploded and those without an item dropped after it."""
    return parsed.select(*kept, F.posexplode_outer(items).alias("_at", name)).where("_at is not null")


def shaped_amounts(requests: DataFrame) -> DataFrame:
    """Who takes part in each request, with what is wrong with its document (`shape`), from one parse.

    Its money is summed up inside the document: each row carries whether the bill is `negative` or `unbalanced`, but no amounts, and of a
    name only whether there is one, so that what is looked up and grouped later is narrow. A request without amounts keeps one row.
    """
    amounts, whole = F.col("doc.amounts"), ["transaction_id", "creator_id", "shape", "negative", "unbalanced"]

    def summed(field: str) -> Column:
        return F.aggregate(amounts, F.lit(0).cast(TOTAL), lambda before, amount: (before + amount[field]).cast(TOTAL))

    return (
        _parsed(requests)
        .withColumn("shape", _shape_reason())
        .withColumn("negative", F.exists(amounts, lambda amount: (amount["amountPaid"] < 0) | (amount["amountToPay"] < 0)))
        .withColumn("unbalanced", unbalanced(summed("amountPaid"), summed("amountToPay")))
        .select(*whole, F.posexplode_outer(amounts).alias("_at", "_amount"))
        .select(*whole, *_amount_columns())
        .withColumn("account_name", F.when(~blank(F.col("account_name")), "named"))
        .drop("amount_to_pay", "amount_paid")
    )


# The document as it is read from the parsed body, in one go; every scalar still with its JSON type.
_AMOUNT = "struct<accountId:variant,accountName:variant,amountToPay:variant,amountPaid:variant>"
_SHAPE = "struct<category:variant,isIncome:variant,includeInReports:variant,description:variant,notes:variant,amounts:variant,tags:variant>"
# Wide enough to see whether a number fits its column.
_WIDE = "decimal(38,18)"


def _parsed(requests: DataFrame) -> DataFrame:
    """`doc` with the content in its columns' types, NULL in a body with a `type_fault`."""
    # What is no object gives no struct.
    raw = (
        requests.withColumn("_json", F.try_parse_json("body"))
        .withColumn("_raw", F.try_variant_get("_json", "$", _SHAPE))
        .withColumn("_amounts", F.try_variant_get("_raw.amounts", "$", f"array<{_AMOUNT}>"))
        .withColumn("_amounts", F.transform(F.transform("_amounts", _amount_values), _amount))
        .withColumn("_tags", F.try_variant_get("_raw.tags", "$", "array<variant>"))
        .withColumn("type_fault", F.when(F.col("_json").isNull(), "not_json").when(~_fits(), "bad_type"))
    )
    doc = F.struct(
        *[_read(f"_raw.{name}", "string").alias(name) for name in _TEXTS],
        *[_read(f"_raw.{name}", "boolean").alias(name) for name in _FLAGS],
        F.col("_amounts").alias("amounts"),
        F.transform("_tags", lambda tag: _read(tag, "string")).alias("tags"),
    )
    return raw.select(
        F.col("request_id").alias("transaction_id"),
        F.col("user_id").alias("creator_id"),
        F.col("received_on").alias("created_on"),
        "type_fault",
        F.when(F.col("type_fault").isNull(), doc).alias("doc"),
    )


_TEXTS = ("category", "description", "notes")
_FLAGS = ("isIncome", "includeInReports")


def _read(json: Column | str, kind: str) -> Column:
    return F.try_variant_get(json, "$", kind)


def _kind(json: Column | str) -> Column:
    """The JSON type: STRING, BOOLEAN, a number type, OBJECT<...>, ARRAY<...>, VOID for null; NULL if there is nothing."""
    return F.schema_of_variant(json)


def _absent_or(json: Column, fits: Column) -> Column:
    return json.isNull() | fits


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _fits() -> Column:
    """Whether every field that is there has its type. null has none; a number is whole where 2.0 and 2e0 are."""
    fits = F.col("_raw").isNotNull()
    for names, kind in ((_TEXTS, "STRING"), (_FLAGS, "BOOLEAN")):
        for name in names:
            fits &= _absent_or(F.col(f"_raw.{name}"), _kind(f"_raw.{name}") == kind)
    # What is no array, or holds something else than objects, could not be read as one.
    fits &= _absent_or(F.col("_raw.amounts"), F.col("_amounts").isNotNull() & F.forall("_amounts", lambda amount: amount["fits"]))
    return fits & _absent_or(F.col("_raw.tags"), F.col("_tags").isNotNull() & F.forall("_tags", lambda tag: _kind(tag) == "STRING"))


_NUMBERS = ("accountId", "amountToPay", "amountPaid")


def _amount_values(amount: Column) -> Column:
    """Kind and value of each field of one amount, taken from the JSON once: `_amount` asks for them many times."""
    name = amount["accountName"]
    return F.struct(
        amount.isNotNull().alias("there"),
        *[_kind(amount[field]).alias(f"{field}Kind") for field in _NUMBERS],
        *[_read(amount[field], _WIDE).alias(field) for field in _NUMBERS],
        _absent_or(name, _kind(name) == "STRING").alias("nameFits"),
        _read(name, "string").alias("accountName"),
    )


def _amount(amount: Column) -> Column:
    """One amount in its columns' types, whether it `fits`, and what is wrong with it as `fault`. A number that doesn't fit becomes NULL and is a fault."""
    kinds = {field: amount[f"{field}Kind"] for field in _NUMBERS}
    whole = F.coalesce(amount["accountId"] % 1 == 0, F.lit(True))
    fits = amount["there"] & _absent_or(kinds["accountId"], whole) & amount["nameFits"]
    for kind in kinds.values():
        fits &= _absent_or(kind, _is_number(kind))
    account, name = amount["accountId"].try_cast("bigint"), amount["accountName"]
    fault = F.when(kinds["accountId"].isNotNull() & account.isNull(), "too_large").when(account <= 0, "bad_account_id").when(name == "", "empty_account_name")
    money = []
    for field in ("amountToPay", "amountPaid"):
        value = amount[field]
        stored = value.try_cast(MONEY)
        fault = (
            fault.when(kinds[field].isNull(), "no_amount")
            .when(stored.isNull(), "too_large")
            .when(value < 0, "negative")
            .when(value != stored, "too_precise")
        )
        money.append(F.when(value == stored, stored).alias(field))
    return F.struct(account.alias("accountId"), name.alias("accountName"), *money, fault.alias("fault"), fits.alias("fits"))


def _amount_columns() -> list[Column]:
    return [
        (F.col("_at") + 1).cast("bigint").alias("slot"),
        F.col("_amount.accountId").alias("account_id"),
        F.col("_amount.accountName").alias("account_name"),
        F.col("_amount.amountToPay").alias("amount_to_pay"),
        F.col("_amount.amountPaid").alias("amount_paid"),
    ]


def _shape_reason() -> Column:
    """What is wrong with the document itself, the first fault in it; NULL if there is none."""
    doc = F.col("doc")
    amounts = F.coalesce(doc["amounts"], F.array())
    first_fault = F.get(F.array_compact(F.transform(amounts, lambda amount: amount["fault"])), F.lit(0))
    return (
        F.when(F.col("type_fault").isNotNull(), F.col("type_fault"))
        .when(blank(doc["category"]), "no_category")
        .when(doc["description"] == "", "empty_description")
        .when(F.size(amounts) == 0, "empty")
        .when(first_fault.isNotNull(), first_fault)
        .when(F.exists(F.coalesce(doc["tags"], F.array()), lambda tag: tag == ""), "empty_tag")
    )
