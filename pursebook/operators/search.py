"""Finding, counting and paging the transactions a user may see."""

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.times import moment
from pursebook.plans.ordered import newest_first
from pursebook.sources.workspace import written

PAGE_LIMIT = 20


def visible_transactions(amounts: DataFrame, accounts: DataFrame, user_id: int | None = None) -> DataFrame:
    """(user_id, transaction_id) where an account of the user takes part."""
    owners = accounts.select(F.col("id").alias("account_id"), "user_id")
    if user_id is not None:
        owners = owners.where(F.col("user_id") == user_id)
    return (
        amounts.where(F.col("account_id").isNotNull())
        .select("transaction_id", "account_id")
        .join(owners, "account_id")
        .select("user_id", "transaction_id")
        .distinct()
    )


def transactions_with_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Transactions that carry every wanted tag, spelled exactly so."""
    asked = sorted(set(wanted))
    return (
        tags.where(F.col("tag").isin(asked))
        .groupBy("transaction_id")
        .agg(F.count_distinct("tag").alias("_found"))
        .where(F.col("_found") == len(asked))
        .select("transaction_id")
    )


def _header_filter(start: datetime | None, end: datetime | None, category: str | None) -> Column:
    when = F.col("created_on")
    given = []
    if start is not None:
        given.append(when >= moment(start))
    if end is not None:
        given.append(when <= moment(end))
    if category:
        given.append(F.col("category") == category)
    return reduce(and_, given, F.lit(True))


def _month_filter(start: datetime | None, end: datetime | None) -> Column:
    """The same bounds on the month folders of a table laid out by month, so that others are not read."""
    given = []
    if start is not None:
        given.append(F.col("month") >= F.date_format(moment(start), "yyyy-MM"))
    if end is not None:
        given.append(F.col("month") <= F.date_format(moment(end), "yyyy-MM"))
    return reduce(and_, given, F.lit(True))


def transaction_search(
    transactions: DataFrame,
    amounts: DataFrame,
    accounts: DataFrame,
    tags: DataFrame | None = None,
    *,
    user_id: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    category: str | None = None,
    account_id: int | None = None,
    wanted_tags: list[str] | None = None,
) -> DataFrame:
    """Distinct (user_id, id, created_on) for one user or for all; every filter is optional, all must hold."""
    wanted = _header_filter(start, end, category)
    if "month" in transactions.columns:
        wanted = wanted & _month_filter(start, end)
    headers = transactions.where(wanted).select("id", "created_on")
    if wanted_tags:
        tagged = transactions_with_all_tags(tags, wanted_tags).withColumnRenamed("transaction_id", "id")
        headers = headers.join(tagged, "id", "left_semi")
    rows = amounts if account_id is None else amounts.where(F.col("account_id") == account_id)
    seen = visible_transactions(rows, accounts, user_id).withColumnRenamed("transaction_id", "id")
    return seen.join(headers, "id").select("user_id", "id", "created_on")


def search_batch(
    filters: DataFrame, transactions: DataFrame, amounts: DataFrame, accounts: DataFrame, tags: DataFrame
) -> DataFrame:
    """(seq, id, created_on): what each of many searches finds, one row of `filters` each.

    `filters` is the output of `search_filters` with the `user_id` that asks; those with a `reason` find nothing. Every transaction
    is listed under its users, accounts, tags and category. A filter wants some of these lists, and goes through the
    shortest one only; what the time bounds leave of it is looked up in the other lists. So no list is read for a filter
    that has a shorter one, and a filter never meets transactions that none of its own lists hold. Tags that no filter asks for are
    not listed.
    """
    usable = filters.where(F.col("reason").isNull()).select("seq", "user_id", "start_on", "end_on", "category", "account_id", "tags")
    owned = accounts.select(F.col("id").alias("account_id"), F.col("user_id").alias("_owner"))
    usable = usable.join(owned, "account_id", "left")
    # An account that isn't the user's own has nothing for them; one that is makes the user's list needless.
    usable = usable.where(F.col("account_id").isNull() | F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)))
    owner = F.when(F.col("account_id").isNull(), _list_of("u", "user_id")).otherwise(_list_of("a", "account_id"))
    wanted = F.array_distinct(
        F.concat(
            F.array(owner),
            F.when(F.col("category").isNull(), F.array().cast("array<string>")).otherwise(F.array(_list_of("c", "category"))),
            F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda tag: F.concat(F.lit("t:"), tag)),
        )
    )
    asked = usable.select("seq", "start_on", "end_on", F.explode(wanted).alias("_list"))
    tags_asked = written(usable.select(F.explode("tags").alias("tag")).distinct(), "tags-asked")
    # With their time, so that the bounds are checked where a search meets its list and nothing out of time is shuffled.
    listed = _lists(transactions, amounts, accounts, tags.join(tags_asked, "tag", "left_semi"))
    listed = written(listed.join(transactions.select("id", "created_on"), "id"), "lists")
    lengths = listed.groupBy("_list").agg(F.count(F.lit(1)).alias("_length"))
    # What a search wants is put together once; what it meets carries its number and not its lists.
    first = F.min(F.struct(F.coalesce("_length", F.lit(0)).alias("length"), F.col("_list").alias("list"))).alias("_first")
    searches = asked.join(lengths, "_list", "left").groupBy("seq", "start_on", "end_on").agg(first, F.collect_list("_list").alias("_wanted"))
    searches = searches.where("_first.length > 0").select(
        "seq", "start_on", "end_on", F.col("_first.list").alias("_list"), F.array_remove("_wanted", F.col("_first.list")).alias("_others")
    )
    searches = written(searches, "searches")
    in_time = F.coalesce(F.col("created_on") >= F.col("start_on"), F.lit(True)) & F.coalesce(F.col("created_on") <= F.col("end_on"), F.lit(True))
    candidates = (
        searches.select("seq", "start_on", "end_on", "_list", F.size("_others").alias("_needed"))
        .join(listed, "_list")
        .where(in_time)
        .select("seq", "id", "created_on", "_needed")
    )
    candidates = written(candidates, "candidates")
    checked = (
        candidates.where("_needed > 0")
        .join(searches.select("seq", F.explode("_others").alias("_list")), "seq")
        .join(listed, ["_list", "id"], "left_semi")
        .groupBy("seq", "id", "created_on", "_needed")
        .agg(F.count(F.lit(1)).alias("_held"))
        .where(F.col("_held") == F.col("_needed"))
    )
    return candidates.where("_needed = 0").select("seq", "id", "created_on").unionByName(checked.select("seq", "id", "created_on"))


def _list_of(kind: str, key: str) -> Column:
    """The name of a list, short because it goes with every row: u(ser), a(ccount), t(ag) or c(ategory), and which one."""
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _lists(transactions: DataFrame, amounts: DataFrame, accounts: DataFrame, tags: DataFrame) -> DataFrame:
    """(_list, id): each transaction under everything a search can ask for, once."""
    rows = amounts.where(F.col("account_id").isNotNull()).select(F.col("transaction_id").alias("id"), "account_id")
    users = visible_transactions(amounts, accounts).select(_list_of("u", "user_id").alias("_list"), F.col("transaction_id").alias("id"))
    by_account = rows.select(_list_of("a", "account_id").alias("_list"), "id").distinct()
    by_tag = tags.select(_list_of("t", "tag").alias("_list"), F.col("transaction_id").alias("id")).distinct()
    by_category = transactions.select(_list_of("c", "category").alias("_list"), "id")
    return users.unionByName(by_account).unionByName(by_tag).unionByName(by_category)


def search_batch_pages(found: DataFrame, filters: DataFrame) -> DataFrame:
    """(seq, id, created_on, rank, total): the page that each filter asked for of what it found, newest first."""
    placed = newest_first(found, "seq", "id", name="rank", whole={"total": (F.sum, F.lit(1).cast("bigint"))})
    last = F.col("page_no") * F.col("page_limit")
    paged = placed.join(filters.select("seq", "page_no", "page_limit"), "seq")
    return paged.where((F.col("rank") > last - F.col("page_limit")) & (F.col("rank") <= last)).select("seq", "id", "created_on", "rank", "total")


def _positive(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, not {value!r}")
    return value


def transaction_search_total(found: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """How many transactions each user's search found, and how many pages that makes."""
    pages = F.ceil(F.col("total") / F.lit(_positive("limit", limit))).cast("bigint")
    return (
        found.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("total"))
        .select("user_id", "total", pages.alias("total_pages"))
    )


def transaction_page(found: DataFrame, page: int = 1, limit: int = PAGE_LIMIT) -> DataFrame:
    """One page of one user's search, newest first; a page past the end is empty."""
    skipped = (_positive("page", page) - 1) * _positive("limit", limit)
    return found.orderBy(F.desc("created_on"), F.desc("id")).offset(skipped).limit(limit)


def transaction_pages(found: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """All pages of all users, newest first: the place of each transaction and the page it is on."""
    _positive("limit", limit)
    placed = newest_first(found, "user_id", "id", name="rank", whole={"total": (F.sum, F.lit(1).cast("bigint"))})
    page_no = F.ceil(F.col("rank") / F.lit(limit)).cast("bigint")
    return placed.select("user_id", "id", "created_on", "rank", page_no.alias("page_no"), "total")
