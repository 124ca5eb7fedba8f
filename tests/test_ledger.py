"""Invariants of the whole ledger, and batch against stream."""

from datetime import datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pursebook import catalog
from pursebook.operators import balances, edits, search
from pursebook.operators.requests import flatten_requests
from pursebook.schemas import AMOUNT_CHANGES, FRIEND_ACTIONS, REQUESTS
from pursebook.sources import files, workspace
from pursebook.sources.derive import Ledger
from pursebook.operators import balances as balance_ops
from pursebook.streaming import balances as live_balances
from pursebook.streaming import friendships as live_friendships
from pursebook.streaming import splits as live_splits
from test_scale import play


def by_account(frame, value="balance"):
    return {r["account_id"]: r[value] for r in frame.collect()}


def test_refreshed_balances_are_the_balances_after(ledger):
    """Replaying the feed's later changes onto the balances gives the balances of the changed amounts."""
    changes = ledger["amount_changes"]
    last = changes.groupBy((F.col("change_id") / 4).cast("bigint").alias("id"), "transaction_id").agg(
        F.max_by("new_account_id", "change_id").alias("account_id"),
        F.max_by("new_paid", "change_id").alias("amount_paid"),
        F.max_by("op", "change_id").alias("op"),
    )
    after = last.where("op <> 'D'")
    expected = by_account(balances.account_balances(ledger["accounts"], ledger["transactions"], after))
    assert by_account(catalog.refresh_balances(ledger)) == expected


def test_edit_deltas_lead_to_the_edited_balances(ledger):
    refreshed = balances.refresh_balances(catalog.account_balances(ledger), catalog.edit_deltas(ledger))
    assert by_account(refreshed) == by_account(catalog.edited_ledger(ledger))


def test_direction_changes_lead_to_the_turned_balances(ledger):
    turned = edits.apply_transaction_patches(ledger["transactions"], ledger["transaction_patches"])
    expected = by_account(balances.account_balances(ledger["accounts"], turned, ledger["transaction_amounts"]))
    delta = catalog.balance_delta_from_direction_change(ledger)
    assert by_account(balances.refresh_balances(catalog.account_balances(ledger), delta)) == expected


def test_accepted_splits_even_out(ledger):
    good = catalog.split_validation(ledger).where("verdict = 'ok'")
    rows = ledger["transaction_amounts"].join(good, "transaction_id", "left_semi")
    gaps = rows.groupBy("transaction_id").agg(F.sum(F.col("amount_paid") - F.col("amount_to_pay")).alias("gap"))
    assert gaps.where("abs(gap) >= 0.01").count() == 0 and gaps.count() > 0


def test_friends_are_mutual(ledger):
    edges = {(r["user_id"], r["friend_id"]) for r in catalog.friend_list(ledger).collect()}
    assert edges and edges == {(b, a) for a, b in edges}


def test_tables_survive_the_disk(spark, ledger, tmp_path):
    for name in files.SCHEMAS:
        files.write_table(ledger[name], str(tmp_path), name, by_month=True)
        back = files.read_table(spark, str(tmp_path), name, by_month=True).select(*files.SCHEMAS[name].fieldNames())
        assert back.exceptAll(ledger[name]).count() == 0 and back.count() == ledger[name].count()
    headers = files.read_table(spark, str(tmp_path), "transactions", by_month=True)
    bounds = {"start": datetime(1996, 7, 1), "end": datetime(1997, 2, 3)}
    rest = ledger["transaction_amounts"], ledger["accounts"]
    found = search.transaction_search(headers, *rest, **bounds)
    assert found.exceptAll(search.transaction_search(ledger["transactions"], *rest, **bounds)).count() == 0
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "(month#" in plan and ">= 1996-07)" in plan and "<= 1997-02)" in plan


def test_requests_survive_as_json_lines(spark, ledger, tmp_path):
    ledger["split_requests"].write.json(str(tmp_path / "in"))
    back = files.read_requests(spark, str(tmp_path / "in"))
    assert flatten_requests(back).amounts.exceptAll(flatten_requests(ledger["split_requests"]).amounts).count() == 0
    documents = catalog.documents.transaction_documents(
        ledger["transactions"], ledger["transaction_amounts"], ledger["transaction_tags"]
    )
    files.write_documents(documents, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == documents.count()


class Session:
    """What shared_folder asks a session for."""

    def __init__(self, master, folder=None):
        settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = settings
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_the_shared_folder_is_the_one_the_session_names():
    assert workspace.shared_folder(Session("yarn", "hdfs://cluster/shared/")) == "hdfs://cluster/shared"
    assert workspace.run_folder(Session("yarn", "hdfs://cluster/shared"), "feed").startswith("hdfs://cluster/shared/feed-")
    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session("yarn"))
    local = workspace.shared_folder(Session("local[2]"))
    assert local == workspace.shared_folder(Session("local[2]"))


def test_tables_are_written_to_the_shared_folder(spark, ledger):
    ledger["users"]
    path = Ledger._written[spark.sparkContext.applicationId, ledger.folder, "users"]
    assert path.startswith(workspace.shared_folder(spark))


def test_streamed_balances_equal_the_batch(spark, ledger, tmp_path):
    """The feed in several files, one micro-batch each, and part of it delivered again."""
    changes, feed = ledger["amount_changes"], str(tmp_path / "feed")
    changes.repartition(3).write.parquet(feed)
    changes.where("op = 'D'").write.mode("append").parquet(feed)
    stream = spark.readStream.schema(AMOUNT_CHANGES).option("maxFilesPerTrigger", 1).parquet(feed)
    running = live_balances.stream_balance_changes(stream, "10000 days")
    found = live_balances.run_balances(running, str(tmp_path / "out"))
    assert by_account(found, "delta") == by_account(catalog.balance_delta_from_changes(ledger), "delta")


def test_a_streamed_change_needs_no_stored_transaction(spark, tmp_path):
    """Changes of a transaction nobody has stored count; those without a direction are put aside."""
    day, feed = datetime(2024, 1, 1), str(tmp_path / "feed")
    rows = [
        (1, day, "I", 77, None, None, 5, Decimal("9.00"), False),
        (2, day, "I", 78, None, None, 6, Decimal("4.00"), True),
        (3, day, "I", 79, None, None, 6, Decimal("1.00"), None),
    ]
    changes = spark.createDataFrame(rows, AMOUNT_CHANGES)
    changes.write.parquet(feed)
    stream = spark.readStream.schema(AMOUNT_CHANGES).parquet(feed)
    found = live_balances.run_balances(live_balances.stream_balance_changes(stream, "1 day"), str(tmp_path / "out"))
    assert {r["account_id"]: r["delta"] for r in found.collect()} == {5: Decimal("-9.0000"), 6: Decimal("4.0000")}
    assert [r["change_id"] for r in live_balances.undirected(changes).collect()] == [3]


def test_streamed_direction_changes_equal_the_batch(spark, ledger, tmp_path):
    turns, feed = catalog._turns(ledger), str(tmp_path / "feed")
    turns.write.parquet(feed)
    turns.write.mode("append").parquet(feed)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    running = live_balances.stream_direction_changes(stream, ledger["transaction_amounts"], "10000 days")
    found = live_balances.run_balances(running, str(tmp_path / "out"))
    assert by_account(found, "delta") == by_account(catalog.balance_delta_from_direction_change(ledger), "delta")


def test_late_changes_are_booked_once(spark, tmp_path):
    """A change far behind the watermark is set aside and booked by the correction; one delivered again is not, in time or late."""
    day, landing = datetime(2024, 1, 1), str(tmp_path / "feed")

    def change(number, days, paid):
        return (number, day + timedelta(days=days), "I", 7, None, None, 5, Decimal(paid), True)

    batches = [[change(1, 0, "1.00"), change(2, 90, "2.00")], [change(3, 60, "4.00"), change(1, 0, "1.00"), change(2, 90, "2.00"), change(4, 5, "8.00")], [change(4, 5, "8.00"), change(5, 85, "16.00")]]
    for rows in batches:
        spark.createDataFrame(rows, AMOUNT_CHANGES).coalesce(1).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(AMOUNT_CHANGES).parquet(landing)
        found = live_balances.run_with_corrections(
            feed,
            str(tmp_path / "out"),
            "10 days",
            lambda changes: live_balances.stream_balance_changes(changes, "10 days"),
            lambda late: balance_ops.balance_delta_from_changes(late),
        )
    assert by_account(found, "delta") == {5: Decimal("31.0000")}
    late = live_balances.late_changes(feed, str(tmp_path / "out"))
    assert sorted(r["change_id"] for r in late.collect()) == [3, 4]


def test_a_batch_of_many_files_is_taken_in_as_a_whole(spark, tmp_path):
    """The newest rows are in the first file of a batch: the others are in time all the same, and are one micro-batch."""
    landing, out = str(tmp_path / "feed"), str(tmp_path / "out")
    rows = [(n, datetime(2024, 1, 1) + timedelta(days=400 - n), "I", 7, None, None, n % 5, Decimal(n), True) for n in range(400)]
    spark.createDataFrame(rows, AMOUNT_CHANGES).repartitionByRange(4, "change_id").write.parquet(landing)
    feed = spark.readStream.schema(AMOUNT_CHANGES).parquet(landing)
    found = live_balances.run_with_corrections(
        feed,
        out,
        "10 days",
        lambda changes: live_balances.stream_balance_changes(changes, "10 days"),
        lambda late: balance_ops.balance_delta_from_changes(late),
    )
    assert by_account(found, "delta") == {k: Decimal(sum(range(k, 400, 5))) for k in range(5)}
    assert len(list((tmp_path / "out/admitted").glob("*/*.parquet"))) > 1
    filled = spark.read.parquet(f"{out}/in-time/rows").select("batch").distinct().count()
    assert filled == 1 and live_balances.late_changes(feed, out).isEmpty()


def test_streamed_requests_are_stored_or_put_aside(spark, ledger, tmp_path):
    requests, feed, out = ledger["split_requests"], str(tmp_path / "feed"), str(tmp_path / "out")
    requests.repartition(3).write.parquet(feed)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(feed)
    found = live_splits.run_split_validation(stream, ledger["accounts"], ledger["friends"], out)
    verdicts = {r["transaction_id"]: r["verdict"] for r in catalog.request_verdicts(ledger).collect()}
    good = {key for key, verdict in verdicts.items() if verdict == "ok"}
    aside = {r["request_id"]: r["verdict"] for r in found.quarantine.collect()}
    assert {r["id"] for r in found.headers.collect()} == good
    assert {r["transaction_id"] for r in found.amounts.collect()} == good
    assert aside == {key: verdict for key, verdict in verdicts.items() if verdict != "ok"}
    assert set(aside.values()) >= {"empty", "negative", "neither", "both", "unknown_account", "no_access", "unbalanced", "no_self"}


def test_a_broken_batch_of_requests_shows_nothing(spark, ledger, tmp_path, monkeypatch):
    """The run breaks after the batch is written and before it is published; the next run publishes it once."""
    requests, feed, out = ledger["split_requests"], str(tmp_path / "feed"), str(tmp_path / "out")
    requests.coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(REQUESTS).parquet(feed)

    def broken(batch, batch_id):
        raise RuntimeError("lost")

    with monkeypatch.context() as lost:
        lost.setattr(live_splits, "_publication", broken)
        with pytest.raises(Exception, match="lost"):
            live_splits.run_split_validation(stream, ledger["accounts"], ledger["friends"], out)
    spark.createDataFrame([], "id int").write.parquet(f"{out}/published/batch=-1")
    assert spark.read.parquet(f"{out}/requests").count() == requests.count()
    assert [table.count() for table in live_splits.published(stream, out)] == [0] * 5
    found = live_splits.run_split_validation(stream, ledger["accounts"], ledger["friends"], out)
    assert found.verdicts.count() == requests.count()
    assert found.headers.count() == found.verdicts.where("verdict = 'ok'").count() > 0


def test_streamed_friendships_set_late_actions_aside(spark, tmp_path):
    """Actions come in any order within three hours; later ones are set aside, and their pair is replayed from the log."""
    day = datetime(2024, 1, 1)
    first = [(2, day + timedelta(hours=1), 2, 1, "accept"), (3, day, 5, 4, "request"), (7, day + timedelta(hours=2), 8, 9, "request")]
    second = [(1, day, 1, 2, "request"), (6, day, 4, 4, "request"), (3, day, 5, 4, "request"), (8, day + timedelta(hours=9), 9, 8, "accept")]
    third = [(4, day + timedelta(minutes=5), 1, 2, "remove"), (5, day + timedelta(hours=8), 2, 1, "remove"), (1, day, 1, 2, "request")]
    landing, out = str(tmp_path / "feed"), str(tmp_path / "out")
    expected = [{(1, 2): (0, 0), (4, 5): (2, 0), (8, 9): (1, 0)}, {(1, 2): (3, 0), (4, 5): (2, 0), (8, 9): (3, 0)}, {(1, 2): (0, 1), (4, 5): (2, 0), (8, 9): (3, 0)}]
    for rows, states in zip((first, second, third), expected, strict=True):
        spark.createDataFrame(rows, FRIEND_ACTIONS).coalesce(1).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(FRIEND_ACTIONS).parquet(landing)
        found = live_friendships.run_friendship_state(feed, out, "3 hours")
        assert {(r["lo"], r["hi"]): (r["state"], r["late"]) for r in found.collect()} == states
    assert [r["seq"] for r in live_friendships.late_actions(feed, out).collect()] == [4]
    written = spark.read.parquet(f"{out}/in-time/rows").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in written][:3] == [3, 2, 1]


def test_streamed_friendships_keep_one_state_and_have_no_batches_without_rows(spark, tmp_path):
    landing, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for day in (1, 11, 21):
        rows = [(day, datetime(2024, 1, day), 1, 2, "request")]
        spark.createDataFrame(rows, FRIEND_ACTIONS).write.mode("append").parquet(landing)
        live_friendships.run_friendship_state(spark.readStream.schema(FRIEND_ACTIONS).parquet(landing), out, "2 days")
    checkpoint = tmp_path / "out" / "in-time" / "checkpoint"
    assert sorted(file.name for file in (checkpoint / "commits").glob("[0-9]*")) == ["0", "1", "2"]
    assert [folder.name for folder in (checkpoint / "state").glob("[0-9]*")] == ["0"]


def test_streamed_friendships_equal_the_replay(spark, ledger, tmp_path):
    """The log in shuffled files, one a trigger, in disorder within the delay."""
    log, landing = ledger["friend_actions"], str(tmp_path / "feed")
    for i in range(3):
        log.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(landing)
    feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    found = live_friendships.run_friendship_state(feed, str(tmp_path / "out"), "400 days")
    states = {(r["lo"], r["hi"]): r["state"] for r in found.collect()}
    assert states == {(r["lo"], r["hi"]): r["state"] for r in catalog.friendship_replay(ledger).collect()}
    assert found.agg(F.sum("late")).first()[0] == 0


def test_money_is_exact(spark, table):
    rows = table("id long, transaction_id long, account_id long, amount_paid decimal(19,4)", [(i, 1, 1, Decimal("0.1")) for i in range(10)])
    headers = table("id long, is_income boolean", [(1, True)])
    accounts = table("id long, user_id long, opening_balance decimal(19,4)", [(1, 1, Decimal("0.0001"))])
    assert balances.account_balances(accounts, headers, rows).first()["balance"] == Decimal("1.0001")
