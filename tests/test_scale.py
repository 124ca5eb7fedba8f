"""Plan shapes for large and skewed data, checked against brute force on small data."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pursebook import catalog
from pursebook.operators import balances, documents, friends, requests, search, splits, users
from pursebook.operators.friends import action_effects
from pursebook.plans import ordered, skew
from pursebook.plans.claims import with_first_claim
from pursebook.sources import derive, workspace

DAY = datetime(2024, 1, 1)
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_bodies_of_requests_are_parsed_once(spark, ledger):
    """No filter that is pushed below the parse repeats it."""
    for part in requests.flatten_requests(ledger["split_requests"]):
        plan = part._jdf.queryExecution().optimizedPlan()
        parses = [line for line in plan.toString().split("\n") if "parseJson" in line]
        assert len(parses) == 1 and parses[0].count("parseJson") == 1


def test_running_totals_over_a_hot_group(spark):
    """One of many groups holds a third of the rows and spans many blocks."""
    rows = spark.range(30_000).select(
        (F.col("id") * 97 % 1_000_003).alias("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("g"),
        (F.col("id") % 11 - 3).cast("decimal(19,4)").alias("v"),
    )
    placed = ordered.with_earlier_totals(
        rows,
        ["g"],
        F.shiftright("id", 8),
        [F.asc("id")],
        {"before": F.col("v"), "rank": F.lit(1)},
        {"all": (F.sum, F.col("v")), "last": (F.max, F.col("id"))},
    ).toPandas()
    for _, group in placed.groupby("g"):
        group = group.sort_values("id").reset_index(drop=True)
        assert list(group["rank"]) == list(range(len(group)))
        running = Decimal(0)
        for value, before in zip(group["v"], group["before"]):
            assert before == running
            running += value
        assert set(group["all"]) == {running} and set(group["last"]) == {group["id"].max()}


def test_no_task_gets_a_whole_hot_group(spark):
    """The windows of the running totals run over (group, block), and over one row for each block."""
    rows = spark.range(0, 100_000).select("id", F.lit(1).alias("g"), F.lit(1).alias("v"))
    placed = ordered.with_earlier_totals(rows, ["g"], F.shiftright("id", 12), [F.asc("id")], {"n": F.col("v")})
    by_task = placed.withColumn("task", F.spark_partition_id()).groupBy("task").count().toPandas()
    assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert by_task["count"].max() < 60_000


def test_pages_of_all_users_are_the_pages_of_each(ledger):
    found = catalog._everything(ledger)
    pages = defaultdict(list)
    for row in search.transaction_pages(found, limit=5).orderBy("rank").collect():
        pages[row["user_id"], row["page_no"]].append(row["id"])
    for user in (1, 2, 3):
        alone = found.where(F.col("user_id") == user)
        for page in (1, 2, 3, 1000):
            listed = [r["id"] for r in search.transaction_page(alone, page, 5).collect()]
            assert listed == pages.get((user, page), [])


def test_documents_have_one_shape_at_every_size(spark):
    """A transaction with very many children is one row like any other; the other rows stay as they are."""

    def built(large):
        headers = spark.range(1, 4).select("id", F.lit("c").alias("category"))
        owner = F.when(F.col("id") < large, 1).otherwise(F.col("id") % 3 + 1).cast("long")
        children = spark.range(large + 300).select("id", owner.alias("transaction_id"))
        empty = F.lit(None)
        amounts = children.select(
            "*", *(empty.cast(t).alias(n) for n, t in (("account_id", "long"), ("account_name", "string"), ("created_on", "date"))),
            *(F.lit(1).cast("decimal(19,4)").alias(n) for n in ("amount_to_pay", "amount_paid")),
        )
        tags = children.select("*", F.lit("t").alias("tag"))
        texts = {r["transaction_id"]: len(r["text"].split(", ")) for r in documents.tag_list_text(tags).collect()}
        found = documents.transaction_documents(headers, amounts, tags)
        sizes = {r[0]: (r[1], r[2]) for r in found.select("transaction_id", F.size("amounts"), F.size("tags")).collect()}
        assert found.count() == 3 and {i: (n, n) for i, n in texts.items()} == sizes
        return found.schema, sizes

    small, large = built(0), built(1_100_000)
    assert small[0] == large[0]
    assert large[1][1][0] >= 1_100_000 and large[1][2] == small[1][2]


def test_reports_of_a_transaction_with_many_payers_and_tags(spark):
    """A grid of cells gives the rows of a plain join."""
    one = F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 7).cast("long").alias("transaction_id")
    payers = spark.range(1000).select(one, F.col("id").alias("user_id"), "id")
    tags = spark.range(600).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id") % 9).cast("long").alias("transaction_id"), F.concat(F.lit("t"), "id").alias("tag"))
    gridded = skew.join_grid(payers, tags, "transaction_id", "user_id", "tag", share_bits=6)
    assert sorted(gridded.columns) == ["id", "tag", "transaction_id", "user_id"]
    plain = payers.join(tags, "transaction_id")
    columns = ["transaction_id", "user_id", "id", "tag"]
    assert gridded.count() == plain.count() > 450_000
    assert gridded.select(columns).exceptAll(plain.select(columns)).isEmpty()


def test_blocks_of_a_pair_that_fills_an_hour_are_bounded(spark):
    """All of a pair's actions fall in one minute; no fold collects more than a block."""
    log = spark.range(30_000).select(
        F.col("id").alias("seq"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 50)").alias("ts"),
        (F.col("id") % 2 + 1).alias("actor_id"), (2 - F.col("id") % 2).alias("target_id"), F.element_at(F.array(F.lit("request"), F.lit("accept"), F.lit("remove")), (F.col("id") % 3 + 1).cast("int")).alias("action"),
    )
    blocks = friends.in_blocks(friends.with_pair(log)).groupBy("lo", "hi", F.shiftright("place", friends.BLOCK_BITS)).count()
    assert blocks.agg(F.max("count")).first()[0] <= 1 << friends.BLOCK_BITS
    assert [r["state"] for r in friends.friendship_replay(log).collect()] == list(play([tuple(r) for r in log.collect()]).values())


def play(actions):
    """State of each pair, action by action."""
    effects, states = action_effects(), {}
    for _, _, actor, target, action in sorted(actions, key=lambda a: (a[1], a[0])):
        if actor != target:
            pair = (min(actor, target), max(actor, target))
            follows = effects.get((action, actor == pair[0]), (0, 1, 2, 3))
            states[pair] = follows[states.get(pair, 0)]
    return states


def test_replay_of_a_hot_pair(spark):
    """A third of the log belongs to one pair, over many hours; ties in time are broken by seq."""
    draw = random.Random(5)
    actions = []
    for seq in range(6_000):
        pair = (1, 2) if draw.random() < 0.34 else draw.sample(range(1, 30), 2)
        actor, target = draw.sample(list(pair), 2) if draw.random() < 0.98 else (pair[0], pair[0])
        action = draw.choice(["request", "accept", "reject", "remove", "request", "accept", "wave"])
        actions.append((seq, DAY + timedelta(minutes=draw.randrange(40_000)), actor, target, action))
    log = spark.createDataFrame(actions, "seq long, ts timestamp_ntz, actor_id long, target_id long, action string")
    states = {(r["lo"], r["hi"]): r["state"] for r in friends.friendship_replay(log).collect()}
    assert states == play(actions)


def test_effects_follow_the_rules():
    """The table of effects against the rules in words."""
    for (action, by_lower), follows in action_effects().items():
        for state, after in enumerate(follows):
            asked_by_lower = {1: True, 2: False}.get(state)
            if action == "request" and state == 0:
                expected = 1 if by_lower else 2
            elif action in ("accept", "reject") and asked_by_lower is (not by_lower):
                expected = 3 if action == "accept" else 0
            elif action == "remove" and state == 3:
                expected = 0
            else:
                expected = state
            assert after == expected


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=25))
def test_registrations_are_served_in_order(spark, wishes):
    requests = [(seq, f"name{n}", f"mail{m}@x.org") for seq, (n, m) in enumerate(wishes, 1)]
    names, mails, expected = set(), set(), {}
    for seq, name, mail in requests:
        free = name not in names and mail not in mails
        expected[seq] = "ok" if free else "taken"
        if free:
            names.add(name)
            mails.add(mail)
    asked = spark.createDataFrame(requests, "seq long, username string, email string")
    nobody = spark.createDataFrame([], "id long, username string, email string, created_on timestamp_ntz")
    verdicts = users.user_registration_checks(asked, nobody)
    assert {r["seq"]: r["verdict"] for r in verdicts.collect()} == expected


def test_a_chain_of_conflicting_registrations(spark, monkeypatch):
    """Each of 1,000 requests wants its predecessor's name or e-mail: decided in a dozen jumps, not in 500 rounds."""
    rounds = []
    real = users.checkpointed
    monkeypatch.setattr(users, "checkpointed", lambda rows: rounds.append(1) or real(rows))
    asked = spark.createDataFrame([(i, f"n{(i + 1) // 2}", f"e{i // 2}") for i in range(1000)], "seq long, _name string, email string")
    assert sorted(r["seq"] for r in users.first_come(asked).collect()) == list(range(0, 1000, 2))
    assert len(rounds) <= 20


def test_first_claims_on_a_hot_key(spark):
    rows = spark.range(1, 10_001).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")
    )
    first = with_first_claim(rows, ["k"], F.col("seq") > 3).where("is_first and k = 0").collect()
    assert [r["seq"] for r in first] == [6]


def test_hot_transaction_and_hot_account(spark, table):
    """A third of the amounts in one transaction, a third on one account, a third guests."""
    n = 9_000
    rows = spark.range(1, n + 1).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 100 + 2).alias("transaction_id"),
        F.when(F.col("id") % 3 == 1, 7).when(F.col("id") % 3 == 0, F.col("id") % 50 + 1).alias("account_id"),
        F.when(F.col("id") % 3 == 2, "Guest").alias("account_name"),
        F.lit(2).cast("decimal(19,4)").alias("amount_to_pay"),
        F.lit(2).cast("decimal(19,4)").alias("amount_paid"),
        F.lit(DAY).cast("timestamp_ntz").alias("created_on"),
    )
    headers = spark.range(1, 102).select(
        "id", F.lit(7).cast("bigint").alias("creator_id"), (F.col("id") == 1).alias("is_income")
    )
    accounts = spark.range(1, 51).select(
        "id", F.col("id").alias("user_id"), F.lit(0).cast("decimal(19,4)").alias("opening_balance")
    )
    edges = spark.range(1, 51).where("id <> 7").select(F.col("id").alias("user_id"), F.lit(7).cast("bigint").alias("friend_id"))
    balance = {r["account_id"]: r["balance"] for r in balances.account_balances(accounts, headers, rows).collect()}
    expected = defaultdict(int)
    for i in range(1, n + 1):
        if i % 3 == 1:
            expected[7] -= 2
        elif i % 3 == 0:
            expected[i % 50 + 1] += 2
    assert balance == {account: expected[account] for account in range(1, 51)}
    verdicts = splits.split_validation(headers, rows, accounts, edges)
    assert verdicts.groupBy("verdict").count().collect()[0]["verdict"] == "ok"
    assert splits.split_remaining(rows).where("not ok").count() == 0


BATCH = [name for name in catalog.QUERIES if not name.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_plans_have_no_nested_loops_and_no_python(ledger, name):
    query = catalog.QUERIES[name](ledger)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "SinglePartition, ENSURE"):
        if operator == "SinglePartition, ENSURE" and ("Subquery" in plan or "TakeOrdered" in plan):
            continue  # one-row maxima, and the one page that is asked for
        assert operator not in plan, plan
    assert ("MapInArrow" in plan) == (name == "edit_sequence")


def test_edits_are_judged_from_one_image(ledger):
    plan = catalog.QUERIES["edit_verdicts"](ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 18


def test_the_first_of_several_edits_is_judged_like_a_single_one(ledger):
    single = catalog.QUERIES["edit_verdicts"](ledger).withColumnRenamed("verdict", "single")
    first = catalog.QUERIES["edit_sequence"](ledger).where("seq % 4 = 1").join(single, "transaction_id", "full")
    assert first.count() and first.where("NOT (verdict <=> single)").count() == 0


def test_search_filters_reach_the_scan(ledger):
    execution = catalog.transaction_search_by_category(ledger)._jdf.queryExecution()
    plan = ledger.spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
    pushed = [line for line in plan.splitlines() if "EqualTo(category,2-HIGH)" in line]
    assert pushed and "GreaterThanOrEqual(created_on" in pushed[0] and "LessThanOrEqual(created_on" in pushed[0]
    assert "ReadSchema: struct<id:bigint,category:string,created_on:timestamp_ntz>" in plan


def test_a_large_parent_is_spread(spark):
    """Shares of 16 rows: every parent with more is split, and each row still meets its parent once."""
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 300).alias("p"))
    parents = spark.range(250).select(F.col("id").alias("p"), (F.col("id") * 2).alias("twice"))
    large = {r["p"]: r["_salts"] for r in skew.large_parents(rows, ["p"], 4).collect()}
    assert large == {0: 63}
    for how, expected in (("inner", 2_800), ("left", 3_000), ("left_semi", 2_800)):
        joined = skew.join_parent(rows, parents, "p", "id", how=how, share_bits=4)
        assert joined.count() == joined.distinct().count()
        assert joined.count() == rows.where("p < 250").count() if how != "left" else rows.count()
    wrong = skew.join_parent(rows, parents, "p", "id", share_bits=4).where("twice <> 2 * p")
    assert wrong.count() == 0


def test_a_large_parent_meets_in_no_single_task(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") < 60_000, 1).otherwise(2).cast("bigint").alias("p"))
    parents = spark.range(3).select(F.col("id").alias("p"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = skew.join_parent(rows, parents, "p", "id", share_bits=8)
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().toPandas()
        grouped = joined.groupBy("p").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4 and tasks["count"].max() < 20_000
    assert "hashpartitioning(p" in grouped and grouped.count("HashAggregate(keys=[p") >= 2


def test_a_hot_account_is_split_at_run_time(spark, ledger):
    """With thresholds made for small data, the skewed side of the join is cut into several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    rows = spark.range(200_000).repartition(8).select(
        "id",
        F.lit(1).cast("bigint").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5_000).alias("account_id"),
    )
    accounts = spark.range(5_000).select("id", F.col("id").alias("user_id"))
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        seen = search.visible_transactions(rows, accounts)
        assert len(seen.collect()) == 5_000
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_lines_are_shuffled_once_to_amounts_and_requests(ledger):
    """Lines and orders each once; what the slots, their sums and the join to the order need comes with it."""
    for make in (derive.transaction_amounts, derive.split_requests):
        plan = make(ledger)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert "ledger-slots" not in plan


def test_tags_are_unfolded_behind_one_shuffle_and_made_for_readers_only(spark, ledger, monkeypatch):
    plan = catalog.duplicate_tags(ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(derive.Ledger, "_written", {})
    for query in (catalog.edit_deltas, catalog.delete_transactions_reversal, catalog.delete_transactions, catalog.edited_ledger):
        query(ledger)
    assert "transaction_amounts" in {name for _, _, name in derive.Ledger._written}
    assert "transaction_tags" not in {name for _, _, name in derive.Ledger._written}


def test_a_body_is_chosen_by_one_look_at_its_kind(ledger):
    """A choice for each kind of faulty body, one in the other, took as long as the rest of making the requests."""
    plan = derive.split_requests(ledger)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(f"% {derive.FAULTY_EVERY}") < 6


def test_lines_are_dealt_by_their_number(ledger, monkeypatch):
    """The tasks that place the lines follow the rows, not the size of what is shuffled; the places stay the same."""
    plain = derive.slots(ledger)
    monkeypatch.setattr(derive, "LINES_PER_TASK", 100)
    dealt = derive.slots(ledger)
    tasks = -(-ledger["lineitem"].count() // 100)
    assert dealt.rdd.getNumPartitions() == tasks > plain.rdd.getNumPartitions()
    assert dealt.exceptAll(plain).isEmpty() and dealt.count() == plain.count()


def test_tags_that_stay_are_looked_up_once(ledger):
    """What stays of the tags doesn't ask first whether the tags to remove are there; a tag asked for twice is gone once."""
    plan = catalog.remove_tags_result(ledger)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" not in plan


def test_requests_are_made_for_the_feed_alone_and_land_compact(ledger, monkeypatch):
    """The feed of the stream is where its requests are written, once, and bodies land as small as the batches made of them."""
    folders = []
    monkeypatch.setattr(derive.Ledger, "_written", {})
    monkeypatch.setattr(catalog, "run_folder", lambda *given: folders.append(workspace.run_folder(*given)) or folders[-1])
    assert catalog.stream_split_validation(ledger).count() == ledger["transaction_amounts"].count()
    assert "split_requests" not in {name for _, _, name in derive.Ledger._written}
    files = [file for folder in folders for file in Path(folder).rglob("*.parquet") if "published" not in str(file)]
    assert files and all(file.name.endswith(".zstd.parquet") for file in files)


def test_no_money_is_shuffled_to_judge_requests(ledger):
    """A bill is summed up where it is parsed; the lookups of its accounts and friends carry what came out."""
    plan = catalog.request_verdicts(ledger)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    shaped = requests.shaped_amounts(ledger["split_requests"])
    assert len(joins) == 2 and not {"amount_paid", "amount_to_pay"} & set(shaped.columns)
    assert not [name for name, kind in shaped.dtypes if kind.startswith("decimal")]
    assert {r["account_name"] for r in shaped.select("account_name").distinct().collect()} == {None, "named"}


def test_lists_of_searches_are_made_once_and_only_of_what_is_asked_for(ledger, monkeypatch):
    """Amounts and tags are gone through once for all that needs the lists; what a search met is in time before it is shuffled."""
    kept = {}
    monkeypatch.setattr(search, "written", lambda rows, name: kept.setdefault(name, workspace.written(rows, name)), raising=False)
    found = catalog.search_batch(ledger)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "account_name" not in plan and "array_remove" not in plan
    asked = {r["tag"] for r in kept["tags-asked"].collect()}
    listed = {r["_list"] for r in kept["lists"].select("_list").distinct().collect() if r["_list"].startswith("t:")}
    assert asked and listed <= {f"t:{tag}" for tag in asked}
    late = kept["candidates"].join(kept["searches"].select("seq", "start_on", "end_on"), "seq").where("created_on < start_on OR created_on > end_on")
    assert late.isEmpty() and set(kept["candidates"].columns) == {"seq", "id", "created_on", "_needed"}
