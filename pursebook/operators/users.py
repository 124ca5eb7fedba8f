"""Users: registration, lookup and session audit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.text import blank, is_email, is_username
from pursebook.functions.times import second_number
from pursebook.sources.workspace import checkpointed, run_folder


def identifier_lookup(identifiers: DataFrame, users: DataFrame) -> DataFrame:
    """Add `found_id`, the user with that name or e-mail, or NULL.

    A user name has no @ and an e-mail has one, so one join on a combined key replaces the OR over
    two columns. Names are compared in lower case, e-mails as they are.
    """
    known = (
        users.select(
            F.explode(
                F.array(
                    F.struct(F.col("username").alias("key"), "id"), F.struct(F.col("email").alias("key"), "id")
                )
            ).alias("entry")
        )
        .groupBy(F.col("entry.key").alias("_key"))
        .agg(F.min("entry.id").alias("found_id"))
    )
    text = F.col("identifier")
    return (
        identifiers.withColumn("_key", F.when(text.contains("@"), text).otherwise(F.lower(text)))
        .join(known, "_key", "left")
        .drop("_key")
    )


def users_by_id(users: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for `ids(id)` with user name, e-mail and time, and whether each was found."""
    asked = ids.select("id").distinct()
    known = users.select("id", "username", "email", "created_on", F.lit(True).alias("_known"))
    return asked.join(known, "id", "left").select(
        "id", "username", "email", "created_on", F.coalesce("_known", F.lit(False)).alias("found")
    )


def user_registration_checks(new_users: DataFrame, users: DataFrame) -> DataFrame:
    """Verdict on each `(seq, username, email)`: well formed, and neither name nor e-mail taken.

    Requests are served in `seq` order: a refused one takes nothing, so the next one with the same
    name may still get it.
    """
    formed = new_users.withColumn("_name", F.lower("username"))
    refusal = (
        F.when(~F.coalesce(is_username(F.col("username")), F.lit(False)), "bad_username")
        .when(~F.coalesce(is_email(F.col("email")), F.lit(False)), "bad_email")
    )
    names = users.select(F.col("username").alias("_name"), F.lit(True).alias("_name_taken")).distinct()
    emails = users.select("email", F.lit(True).alias("_email_taken")).distinct()
    stored = (
        formed.join(names, "_name", "left")
        .join(emails, "email", "left")
        .withColumn("_refusal", F.coalesce(refusal, F.when(F.col("_name_taken") | F.col("_email_taken"), "taken")))
    )
    open_requests = stored.where(F.col("_refusal").isNull()).select("seq", "_name", "email")
    winners = first_come(open_requests).withColumn("_won", F.lit(True))
    return stored.join(winners, "seq", "left").select(
        "seq",
        "username",
        "email",
        F.coalesce("_refusal", F.when(F.col("_won"), "ok"), F.lit("taken")).alias("verdict"),
    )


def first_come(requests: DataFrame) -> DataFrame:
    """The `seq` of the requests that get both their `_name` and their `email`, served in order; one request per `seq`.

    A request gets them if none of the earlier ones that want its name or its e-mail did. Each round grants the requests
    that are first for both, and drops all that want something granted. From the second round on, a request that is behind one
    single other request hangs on it: it wins if that one loses. Such requests form trees, in which pointers jump to the root in
    a number of steps that is the logarithm of the depth, so a chain of alternating conflicts, however long, is decided in one round. Rounds
    and jumps are checkpointed, and what is granted is written as it is found.
    """
    spark, folder = requests.sparkSession, run_folder(requests.sparkSession, "granted")
    waiting, chains = checkpointed(requests), False
    spark.createDataFrame([], requests.select("seq").schema).write.parquet(folder)
    while not waiting.isEmpty():
        won = checkpointed(_decided(waiting) if chains else _first_of_both(waiting).where("_wins"))
        won.select("seq").write.mode("append").parquet(folder)
        waiting = checkpointed(
            waiting.join(won.select("_name"), "_name", "left_anti").join(won.select("email"), "email", "left_anti")
        )
        chains = True
    return spark.read.schema(requests.select("seq").schema).parquet(folder)


def _first_of_both(waiting: DataFrame) -> DataFrame:
    """Add the first request for the same name and for the same e-mail, and whether both are this one."""
    first_name = waiting.groupBy("_name").agg(F.min("seq").alias("_first_name"))
    first_email = waiting.groupBy("email").agg(F.min("seq").alias("_first_email"))
    ranked = waiting.join(first_name, "_name").join(first_email, "email")
    return ranked.withColumn("_wins", (F.col("seq") == F.col("_first_name")) & (F.col("seq") == F.col("_first_email")))


def _decided(waiting: DataFrame) -> DataFrame:
    """The winners among the requests that hang, directly or through others, on one that is first for both."""
    ranked = checkpointed(_first_of_both(waiting))
    for key, name in (("_name", "name"), ("email", "email")):
        second = ranked.where(f"seq <> _first_{name}").groupBy(key).agg(F.min("seq").alias(f"_second_{name}"))
        ranked = ranked.join(second, key, "left")
    first_name, first_email = (F.col("seq") == F.col(f"_first_{name}") for name in ("name", "email"))
    second_name, second_email = (F.coalesce(F.col("seq") == F.col(f"_second_{name}"), F.lit(False)) for name in ("name", "email"))
    behind = (
        F.when(first_name & second_email, F.col("_first_email"))
        .when(first_email & second_name, F.col("_first_name"))
        .when(second_name & second_email & (F.col("_first_name") == F.col("_first_email")), F.col("_first_name"))
    )
    # Each request with the one it hangs on, and whether it wins when that one does.
    pointers = checkpointed(ranked.select("seq", "_name", "email", "_wins", behind.alias("_on"), F.col("_wins").alias("_like")))
    while True:
        on = pointers.select(F.col("seq").alias("_on"), F.col("_on").alias("_next"), F.col("_like").alias("_next_like"))
        jumped = pointers.join(on, "_on", "left")
        if jumped.where(F.col("_next").isNotNull()).isEmpty():
            break
        moved = F.col("_next").isNotNull()
        pointers = checkpointed(
            jumped.select(
                "seq", "_name", "email", "_wins",
                F.when(moved, F.col("_next")).otherwise(F.col("_on")).alias("_on"),
                F.when(moved, F.col("_like") == F.col("_next_like")).otherwise(F.col("_like")).alias("_like"),
            )
        )
    roots = pointers.where("_wins").select(F.col("seq").alias("_on"), F.lit(True).alias("_decided"))
    known = pointers.join(roots, "_on", "left")
    return known.where("_wins OR (_decided AND _like)").select("seq", "_name", "email")


def session_claims_audit(
    claims: DataFrame, users: DataFrame, modified: DataFrame, now: Column, refresh_required: bool = False
) -> DataFrame:
    """First reason a session is refused at time `now`, or `valid`; times count in whole seconds."""

    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    changes = modified.groupBy("user_id").agg(F.max("modified_on").alias("_modified_on"))
    wrong = F.coalesce(F.col("user_id"), F.lit(0)) <= 0
    verdict = (
        F.when(F.col("expires_at").isNull(), "no_expiry")
        .when(F.col("issued_at").isNull(), "no_issue_time")
        .when(second_number("expires_at") < F.col("_now"), "expired")
        .when(second_number("issued_at") > F.col("_now"), "not_yet_valid")
        .when(wrong | blank(F.col("user_name")) | F.col("email").isNull(), "missing_claims")
    )
    if refresh_required:
        verdict = verdict.when(~F.coalesce("refresh", F.lit(False)), "not_refresh")
    verdict = (
        verdict.when(F.col("_known").isNull(), "unknown_user")
        .when(second_number("_modified_on") > second_number("issued_at"), "user_changed")
        .otherwise("valid")
    )
    return (
        claims.withColumn("_now", second_number(now))
        .join(known, "user_id", "left")
        .join(changes, "user_id", "left")
        .select("session_id", "user_id", verdict.alias("verdict"))
    )
