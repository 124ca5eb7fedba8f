"""The state of every pair of users, kept current from the friend log."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pursebook.operators.friends import friendship_replay, with_pair
from pursebook.streaming.admission import admit, admitted, log_of
from pursebook.streaming.sink import write_batches

PAIRS = "lo long, hi long, state int"
# The state after all actions behind the watermark, and the actions after it, which earlier ones may still precede.
_STATE = "settled int, times array<long>, seqs array<long>, effects array<int>"


def stream_friendship_state(friend_actions: DataFrame, delay: str) -> DataFrame:
    """(lo, hi, state) of each pair whenever actions of it come in, in any order within `delay`.

    A pair keeps the state that its actions behind the watermark led to and, in a buffer, the newer ones. What comes in is put
    among them by (ts, seq); the state reported is that after all of them. A buffer is folded when its pair has actions again: it holds
    those of `delay` at most, each once, as a repeated delivery is late or finds its action there. So no second state of delivered
    actions is needed, and no timer, which would call for a batch without rows after each with rows. The state lives in
    the session's state store (RocksDB with `session.SETTINGS`), which writes changes only.
    """
    timed = with_pair(friend_actions).withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", delay)
    actions = timed.select("lo", "hi", "_time", F.unix_micros("_time").alias("time"), "seq", F.col("effect").cast("int").alias("effect"))
    return actions.groupBy("lo", "hi").applyInPandasWithState(_advance, PAIRS, _STATE, "update", GroupStateTimeout.NoTimeout)


def _advance(pair: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    settled, times, seqs, effects = kept.get if kept.exists else (0, [], [], [])
    buffer = {seq: (time, seq, effect) for time, seq, effect in zip(times, seqs, effects, strict=True)}
    watermark, came = kept.getCurrentWatermarkMs() * 1000, False
    for frame in frames:
        for action in zip(frame["time"].tolist(), frame["seq"].tolist(), frame["effect"].tolist(), strict=True):
            if action[0] >= watermark and action[1] not in buffer:
                came, buffer[action[1]] = True, action
    if came:
        ordered = sorted(buffer.values())
        behind = sum(time < watermark for time, _, _ in ordered)
        settled, ordered = _played(settled, ordered[:behind]), ordered[behind:]
        kept.update((settled, *([entry[i] for entry in ordered] for i in range(3))))
        yield pd.DataFrame({"lo": [pair[0]], "hi": [pair[1]], "state": [_played(settled, ordered)]})


def _played(state: int, actions: list[tuple[int, int, int]]) -> int:
    for _, _, effect in actions:
        state = effect >> (2 * state) & 3
    return state


def run_friendship_state(friend_actions: DataFrame, folder: str, delay: str) -> DataFrame:
    """Take in what the feed has; returns (lo, hi, state, late) of every pair that had an action.

    Only pairs with new actions are written, a file set for each micro-batch. Actions behind the watermark, counted as `late`,
    are set aside by `admit`; a pair that has some is replayed from the log of all its actions.
    """
    spark = friend_actions.sparkSession
    admit(friend_actions, "ts", delay, folder)
    stream = admitted(spark, friend_actions.schema, folder)
    write_batches(stream_friendship_state(stream, delay), f"{folder}/in-time", "update").awaitTermination()
    written = spark.read.parquet(f"{folder}/in-time/rows")
    current = written.groupBy("lo", "hi").agg(F.max_by("state", "batch").alias("state"))
    late = with_pair(late_actions(friend_actions, folder))
    counts = late.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("late"))
    log = log_of(friend_actions, folder, "admitted").unionByName(log_of(friend_actions, folder, "late")).dropDuplicates(["seq"])
    again = with_pair(log).join(counts, ["lo", "hi"], "left_semi").select(*friend_actions.columns)
    replayed = friendship_replay(again).join(counts, ["lo", "hi"])
    in_time = current.join(counts, ["lo", "hi"], "left_anti").withColumn("late", F.lit(0).cast("bigint"))
    return in_time.unionByName(replayed)


def late_actions(friend_actions: DataFrame, folder: str) -> DataFrame:
    """The actions that came behind the watermark and hadn't come before, one row each."""
    known = log_of(friend_actions, folder, "admitted").select("seq")
    return log_of(friend_actions, folder, "late").dropDuplicates(["seq"]).join(known, "seq", "left_anti").select(*friend_actions.columns)
