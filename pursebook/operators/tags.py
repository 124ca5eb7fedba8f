"""Tags of transactions."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursebook.functions.text import blank, same_tag
from pursebook.plans.claims import with_mark


class TagChange(NamedTuple):
    verdicts: DataFrame
    tags: DataFrame


def _with_access(requests: DataFrame, visible: DataFrame) -> DataFrame:
    marked = visible.select("user_id", "transaction_id", F.lit(True).alias("_visible"))
    return requests.join(marked, ["user_id", "transaction_id"], "left")


def add_tags(tags: DataFrame, new_tags: DataFrame, visible: DataFrame) -> TagChange:
    """Serve `(seq, user_id, transaction_id, tag)`; a transaction keeps one tag per trimmed lower-case form."""
    key = ["transaction_id", "_same"]
    asked = _with_access(new_tags, visible)
    refusal = F.when(blank(F.col("tag")), "empty").when(F.col("_visible").isNull(), "not_found")
    asked = asked.withColumn("_refusal", refusal)
    # One request of each tag may win; those whose tag is there already do not.
    firsts = (
        asked.where(F.col("_refusal").isNull())
        .groupBy("transaction_id", same_tag("tag").alias("_same"))
        .agg(F.min(F.struct("seq", "tag")).alias("_first"))
    )
    present = tags.select("transaction_id", same_tag("tag").alias("_same"))
    accepted = firsts.join(present, key, "left_anti").select("_first.seq", "transaction_id", "_first.tag")
    verdict = F.coalesce("_refusal", F.when(F.col("_accepted"), "accepted").otherwise("exists"))
    verdicts = with_mark(asked, accepted, "_accepted").select(
        "seq", "user_id", "transaction_id", "tag", verdict.alias("verdict")
    )
    # New ids follow the largest one in use; seq is unique, gaps are harmless.
    last = tags.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = accepted.select((last + F.col("seq")).alias("id"), "transaction_id", "tag")
    return TagChange(verdicts, tags.select("id", "transaction_id", "tag").unionByName(added))


def tags_of_transactions(tags: DataFrame, views: DataFrame, visible: DataFrame) -> DataFrame:
    """Tags of the transactions in `views(user_id, transaction_id)` that the user may see."""
    allowed = views.select("user_id", "transaction_id").distinct().join(
        visible.select("user_id", "transaction_id"), ["user_id", "transaction_id"], "left_semi"
    )
    return tags.join(allowed, "transaction_id").select("user_id", "transaction_id", "id", "tag")


def remove_tags(tags: DataFrame, removals: DataFrame, visible: DataFrame) -> TagChange:
    """Serve `(seq, user_id, transaction_id, tag_id)`; the pair must exist and be visible."""
    pair = ["transaction_id", "id"]
    asked = _with_access(removals, visible)
    allowed = asked.where(F.col("_visible")).select("transaction_id", F.col("tag_id").alias("id"), "seq")
    removed = allowed.groupBy(*pair).agg(F.min("seq").alias("seq")).join(tags.select(*pair), pair, "left_semi")
    verdict = (
        F.when(F.col("_visible").isNull(), "not_found").when(F.col("_removed"), "removed").otherwise("no_such_tag")
    )
    verdicts = with_mark(asked, removed, "_removed").select(
        "seq", "user_id", "transaction_id", "tag_id", verdict.alias("verdict")
    )
    # What stays needs neither which request came first nor whether its tag is there: tags are shuffled once.
    return TagChange(verdicts, tags.join(allowed.select(*pair), pair, "left_anti").select(*tags.columns))


def duplicate_tags(tags: DataFrame) -> DataFrame:
    """Tags a transaction carries more than once, spelled alike or not."""
    return (
        tags.groupBy("transaction_id", same_tag("tag").alias("tag"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
