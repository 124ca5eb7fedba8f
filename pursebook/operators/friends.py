"""The friend graph: one stored row per friendship, read in both directions."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursebook.functions.text import blank
from pursebook.operators.users import identifier_lookup
from pursebook.plans.claims import with_first_claim
from pursebook.plans.ordered import newest_first


def friend_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs, once each, as (lo, hi)."""
    return edges.select(
        F.least("user_id", "friend_id").alias("lo"), F.greatest("user_id", "friend_id").alias("hi")
    ).distinct()


def both_directions(friends: DataFrame) -> DataFrame:
    """(user_id, friend_id) each way, once, with the earliest time; one scan, no union."""
    ways = F.explode(
        F.array(
            F.struct(F.col("user_id").alias("a"), F.col("friend_id").alias("b")),
            F.struct(F.col("friend_id").alias("a"), F.col("user_id").alias("b")),
        )
    )
    return (
        friends.select(ways.alias("way"), "created_on")
        .groupBy(F.col("way.a").alias("user_id"), F.col("way.b").alias("friend_id"))
        .agg(F.min("created_on").alias("created_on"))
    )


def _names(users: DataFrame, key: str) -> DataFrame:
    return users.select(F.col("id").alias(key), "username")


def friend_list(friends: DataFrame, users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Friends with their names, newest first: the place for everybody, a sorted list for one user."""
    if user_id is not None:
        friends = friends.where((F.col("user_id") == user_id) | (F.col("friend_id") == user_id))
    listed, names = both_directions(friends), _names(users, "friend_id")
    if user_id is not None:
        listed = listed.where(F.col("user_id") == user_id).join(names, "friend_id")
        return listed.select("user_id", "friend_id", "username", "created_on").orderBy(
            F.desc("created_on"), F.desc("friend_id")
        )
    # Placed before the names are joined: every friend is a stored user, so none is lost after.
    placed = newest_first(listed, "user_id", "friend_id").join(names, "friend_id")
    return placed.select("user_id", "friend_id", "username", "created_on", "position")


def are_friends(pairs: DataFrame, friends: DataFrame) -> DataFrame:
    """Add `friends` to pairs (user_id, other_id); the direction of the stored row does not matter."""
    edges = friend_pairs(friends).withColumn("_edge", F.lit(True))
    return (
        pairs.withColumn("lo", F.least("user_id", "other_id"))
        .withColumn("hi", F.greatest("user_id", "other_id"))
        .join(edges, ["lo", "hi"], "left")
        .select(*pairs.columns, F.coalesce("_edge", F.lit(False)).alias("friends"))
    )


def incoming_requests(requests: DataFrame, users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Pending requests to a user with the sender's name, newest first."""
    received = requests.select(
        F.col("friend_id").alias("user_id"), F.col("user_id").alias("sender_id"), F.col("created_on")
    )
    if user_id is not None:
        received = received.where(F.col("user_id") == user_id)
    names = _names(users, "sender_id")
    if user_id is not None:
        named = received.join(names, "sender_id").select("user_id", "sender_id", "username", "created_on")
        return named.orderBy(F.desc("created_on"), F.desc("sender_id"))
    placed = newest_first(received, "user_id", "sender_id").join(names, "sender_id")
    return placed.select("user_id", "sender_id", "username", "created_on", "position")


def friend_request_admission(
    new_requests: DataFrame, users: DataFrame, friends: DataFrame, requests: DataFrame
) -> DataFrame:
    """Verdict on each `(seq, user_id, identifier)`; inside the batch the first of a pair wins."""
    found = identifier_lookup(new_requests, users).withColumnRenamed("found_id", "friend_id")
    pair = found.withColumn("lo", F.least("user_id", "friend_id")).withColumn("hi", F.greatest("user_id", "friend_id"))
    # What is stored refuses all requests of a pair alike, so its first request is the one to admit.
    claimed = with_first_claim(pair.where(F.col("friend_id").isNotNull()), ["lo", "hi"])
    edges = friend_pairs(friends).withColumn("_edge", F.lit(True))
    pending = friend_pairs(requests).withColumn("_pending", F.lit(True))
    looked_up = claimed.join(edges, ["lo", "hi"], "left").join(pending, ["lo", "hi"], "left")
    verdict = (
        F.when(F.col("friend_id") == F.col("user_id"), "to_oneself")
        .when(F.col("_edge"), "already_friends")
        .when(F.col("_pending") | ~F.col("is_first"), "pending")
        .otherwise("accepted")
    )
    unknown = F.when(blank(F.col("identifier")), "empty").otherwise("not_found")
    columns = ("seq", "user_id", "identifier", "friend_id")
    return looked_up.select(*columns, verdict.alias("verdict")).unionByName(
        found.where(F.col("friend_id").isNull()).select(*columns, unknown.alias("verdict"))
    )


class Resolution(NamedTuple):
    verdicts: DataFrame
    friends: DataFrame
    requests: DataFrame


def friend_request_resolution(requests: DataFrame, friends: DataFrame, responses: DataFrame) -> Resolution:
    """Answers `(seq, responded_on, user_id, friend_id, action)`: user_id answers what friend_id sent.

    Accepting adds the row (receiver, sender) and drops the request; if that very row is stored
    already the answer fails and the request stays. Rejecting drops it.
    """
    sent = requests.select(
        F.col("user_id").alias("friend_id"), F.col("friend_id").alias("user_id"), F.lit(True).alias("_sent")
    )
    stored = friends.select("user_id", "friend_id", F.lit(True).alias("_stored")).distinct()
    known = responses.join(sent, ["user_id", "friend_id"], "left").join(stored, ["user_id", "friend_id"], "left")
    refusal = (
        F.when(~F.col("action").isin("accept", "reject"), "bad_action")
        .when(F.col("_sent").isNull(), "not_found")
        .when((F.col("action") == "accept") & F.col("_stored"), "already_friends")
    )
    judged = with_first_claim(
        known.withColumn("_refusal", refusal), ["user_id", "friend_id"], F.col("_refusal").isNull()
    )
    done = F.when(F.col("action") == "accept", "accepted").otherwise("rejected")
    verdicts = judged.select(
        "seq",
        "responded_on",
        "user_id",
        "friend_id",
        F.coalesce("_refusal", F.when(F.col("is_first"), done), F.lit("not_found")).alias("verdict"),
    )
    accepted = verdicts.where("verdict = 'accepted'").select(
        "user_id", "friend_id", F.col("responded_on").alias("created_on")
    )
    answered = verdicts.where("verdict in ('accepted', 'rejected')").select(
        F.col("friend_id").alias("user_id"), F.col("user_id").alias("friend_id")
    )
    return Resolution(
        verdicts,
        friends.select("user_id", "friend_id", "created_on").unionByName(accepted),
        requests.join(answered, ["user_id", "friend_id"], "left_anti"),
    )


class Removal(NamedTuple):
    verdicts: DataFrame
    friends: DataFrame


def remove_friends(friends: DataFrame, removals: DataFrame) -> Removal:
    """End friendships `(seq, user_id, friend_id)`, whichever way they are stored."""
    asked = removals.withColumn("lo", F.least("user_id", "friend_id")).withColumn(
        "hi", F.greatest("user_id", "friend_id")
    )
    edges = friend_pairs(friends).withColumn("_edge", F.lit(True))
    judged = with_first_claim(asked, ["lo", "hi"]).join(edges, ["lo", "hi"], "left")
    done = F.col("is_first") & F.col("_edge").isNotNull()
    verdicts = judged.select(
        "seq", "user_id", "friend_id", F.when(done, "removed").otherwise("not_friends").alias("verdict")
    )
    ended = friend_pairs(removals)
    kept = (
        friends.withColumn("lo", F.least("user_id", "friend_id"))
        .withColumn("hi", F.greatest("user_id", "friend_id"))
        .join(ended, ["lo", "hi"], "left_anti")
        .drop("lo", "hi")
    )
    return Removal(verdicts, kept)


# States of a pair, in this order: 0 none, 1 asked by the lower id, 2 asked by the higher id, 3 friends.
STATES = ("none", "pending_low_to_high", "pending_high_to_low", "friends")
UNCHANGED = (0, 1, 2, 3)


def action_effects() -> dict[tuple[str, bool], tuple[int, ...]]:
    """(action, done by the lower id) -> the state that follows each state; illegal actions change nothing."""
    return {
        ("request", True): (1, 1, 2, 3),
        ("request", False): (2, 1, 2, 3),
        ("accept", True): (0, 1, 3, 3),
        ("accept", False): (0, 3, 2, 3),
        ("reject", True): (0, 1, 0, 3),
        ("reject", False): (0, 0, 2, 3),
        ("remove", True): (0, 1, 2, 0),
        ("remove", False): (0, 1, 2, 0),
    }


# A map of states packed into one integer: the state after i in the bits 2 * i and 2 * i + 1.
def packed_effect(follows: tuple[int, ...]) -> int:
    return sum(state << (2 * before) for before, state in enumerate(follows))


UNCHANGED_EFFECT = packed_effect(UNCHANGED)


def _effect() -> Column:
    effect = F.lit(None)
    for (action, by_lower), follows in action_effects().items():
        holds = (F.col("action") == action) & ((F.col("actor_id") == F.col("lo")) == F.lit(by_lower))
        effect = F.when(holds, F.lit(packed_effect(follows))).otherwise(effect)
    return F.coalesce(effect, F.lit(UNCHANGED_EFFECT))


def _follows(effect: Column, state: Column) -> Column:
    return F.call_function("shiftright", effect, (state * 2).cast("int")).bitwiseAND(3)


def _then(first: Column, second: Column) -> Column:
    """One effect after another."""
    states = [_follows(second, F.shiftright(first, 2 * i).bitwiseAND(3)) for i in UNCHANGED]
    return states[0] + states[1] * 4 + states[2] * 16 + states[3] * 64


def _in_order(entries: Column) -> Column:
    """Chain the effects of (place, effect) structs, sorted by place, into one effect."""
    return F.aggregate(F.array_sort(entries), F.lit(UNCHANGED_EFFECT), lambda so_far, entry: _then(so_far, entry["effect"]))


def with_pair(friend_actions: DataFrame) -> DataFrame:
    """Actions between two users with their pair and what they do to its state."""
    return (
        friend_actions.where(F.col("actor_id") != F.col("target_id"))
        .withColumn("lo", F.least("actor_id", "target_id"))
        .withColumn("hi", F.greatest("actor_id", "target_id"))
        .withColumn("effect", _effect())
    )


# A block holds up to 2^BLOCK_BITS actions, a block of blocks up to 2^BLOCK_BITS blocks.
BLOCK_BITS = 12


def in_blocks(actions: DataFrame) -> DataFrame:
    """Add `place`, which follows (lo, hi, ts, seq), so that high bits of it cut a pair's history into blocks of bounded size.

    The actions are sorted over all tasks by ranges that Spark samples: a pair that fills the log gets many ranges, and an
    hour or a moment in which all of it happens may be cut anywhere, as the number of the action counts too.
    """
    spread = actions.repartitionByRange("lo", "hi", "ts", "seq").sortWithinPartitions("lo", "hi", "ts", "seq")
    return spread.withColumn("place", F.monotonically_increasing_id())


def pair_effects(actions: DataFrame) -> DataFrame:
    """What all actions of a pair together do to its state, in (ts, seq) order: (lo, hi, effect).

    An action maps each of the four states to the next one, and such maps chain associatively: a history is folded
    by blocks, these by blocks of blocks, and these by pair. No list is longer than 2^BLOCK_BITS, but for the last one, which has an
    entry for each 16 million actions of the pair and one for each task that held some of them.
    """
    folded = in_blocks(actions).select("lo", "hi", "place", "effect")
    for _ in range(2):
        block = F.shiftright("place", BLOCK_BITS).alias("place")
        folded = folded.groupBy("lo", "hi", block).agg(_in_order(F.collect_list(F.struct(F.col("place"), F.col("effect")))).alias("effect"))
    return folded.groupBy("lo", "hi").agg(_in_order(F.collect_list(F.struct("place", "effect"))).alias("effect"))


def after(effect: Column, state: Column) -> Column:
    """The state that follows; no effect, no change."""
    return F.coalesce(_follows(effect, state), state).cast("int")


def friendship_replay(friend_actions: DataFrame) -> DataFrame:
    """The state every pair ends in when its actions are applied in order, starting without friendship."""
    effects = pair_effects(with_pair(friend_actions))
    return effects.select("lo", "hi", after(F.col("effect"), F.lit(0)).alias("state"))


class Cascade(NamedTuple):
    users: DataFrame
    accounts: DataFrame
    friends: DataFrame
    requests: DataFrame
    closed_accounts: DataFrame


def delete_users_cascade(
    users: DataFrame, accounts: DataFrame, friends: DataFrame, requests: DataFrame, leaving: DataFrame
) -> Cascade:
    """Remove the users in `leaving(user_id)` with their accounts, friendships and requests.

    The accounts that go are returned too; their amounts become guest rows by `guests_instead`.
    """
    gone = leaving.select("user_id").distinct()

    def untouched(edges: DataFrame) -> DataFrame:
        by_friend = gone.select(F.col("user_id").alias("friend_id"))
        return edges.join(gone, "user_id", "left_anti").join(by_friend, "friend_id", "left_anti")

    return Cascade(
        users.join(gone.select(F.col("user_id").alias("id")), "id", "left_anti"),
        accounts.join(gone, "user_id", "left_anti"),
        untouched(friends),
        untouched(requests),
        accounts.join(gone, "user_id", "left_semi"),
    )


def friend_picker(friends: DataFrame, users: DataFrame, accounts: DataFrame, user_id: int | None = None) -> DataFrame:
    """The accounts of a user's friends, as offered when a bill is split; friends without any are left out.

    For one user, or for all: one row for each friendship and account of the friend, so a user with many friends shows their
    accounts to each of them.
    """
    owned = accounts.select(F.col("user_id").alias("friend_id"), F.col("id").alias("account_id"), "name")
    if user_id is None:
        listed = both_directions(friends).join(_names(users, "friend_id"), "friend_id").select("user_id", "friend_id", "username")
        return listed.join(owned, "friend_id").select("user_id", "friend_id", "username", "account_id", "name")
    listed = friend_list(friends, users, user_id).select("friend_id", "username")
    return listed.join(owned, "friend_id").select("friend_id", "username", "account_id", "name")


def friend_directory(
    friends: DataFrame, users: DataFrame, accounts: DataFrame, user_id: int | None = None
) -> DataFrame:
    """Every friend of a user with how many accounts the friend has; the picker offers those with any.

    Counted before the join, so the result is one row per friend however many accounts one has.
    """
    owned = accounts.groupBy(F.col("user_id").alias("friend_id")).agg(F.count(F.lit(1)).alias("accounts"))
    listed = friend_list(friends, users, user_id) if user_id is not None else (
        both_directions(friends).join(_names(users, "friend_id"), "friend_id")
    )
    count = F.coalesce("accounts", F.lit(0).cast("bigint"))
    return listed.join(owned, "friend_id", "left").select(
        "user_id", "friend_id", "username", count.alias("accounts"), (count > 0).alias("offered")
    )
