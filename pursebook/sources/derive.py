"""Ledger tables derived from the given order, customer and event tables.

The given tables hold no users, accounts or splits, so customers become users, orders become
transactions, order lines become the participants' amounts, and events become the friend log and
the sessions. Every given row is used; nothing is sampled.
"""

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from pursebook.schemas import MONEY
from pursebook.sources.workspace import COMPACT, run_folder

GIVEN = ("customer", "orders", "lineitem", "part", "events")
#: order lines of a task that sums, places and joins them; keeps its hash tables and sorts in memory
LINES_PER_TASK = 1 << 19


class Ledger:
    """The derived tables of one data folder; each is written to the shared folder when first used."""

    _written: dict[tuple[str, str, str], str] = {}
    _schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(PurePosixPath(folder))

    def given(self, name: str) -> DataFrame:
        return self._read(f"{self.folder}/{name}.parquet")

    def _read(self, path: str) -> DataFrame:
        """Footers are asked for the schema once, not for every query."""
        if path not in Ledger._schemas:
            Ledger._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(Ledger._schemas[path]).parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        return self.given(name) if name in GIVEN else self.written(name, TABLES[name])

    def unwritten(self, name: str) -> DataFrame:
        """A table that one reader at most needs, and that isn't made where none does."""
        return TABLES[name](self)

    def written(self, name: str, make: Callable[["Ledger"], DataFrame]) -> DataFrame:
        """A table that is made and written once, then read."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in Ledger._written:
            path = run_folder(self.spark, f"ledger-{name}")
            rows = make(self)
            rows.write.options(**COMPACT).parquet(path)
            Ledger._written[key], Ledger._schemas[path] = path, rows.schema
        return self._read(Ledger._written[key])


def days(count: Column) -> Column:
    return F.make_dt_interval(days=count.cast("int"))


def _first_day(ledger: Ledger) -> Column:
    return ledger["orders"].select(F.min("o_orderdate")).scalar()


def _customers(ledger: Ledger) -> Column:
    return ledger["customer"].select(F.count(F.lit(1))).scalar()


def _money(value: Column | str) -> Column:
    return F.col(value).cast(MONEY) if isinstance(value, str) else value.cast(MONEY)


def _text(value: str) -> Column:
    return F.col(value).cast("string")


def users(ledger: Ledger) -> DataFrame:
    name = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))
    return ledger["customer"].select(
        (F.col("c_custkey") + 1).alias("id"),
        name.alias("username"),
        F.concat(name, F.lit("@example.com")).alias("email"),
        (_first_day(ledger) + days(F.col("c_custkey") % 365)).alias("created_on"),
    )


def accounts(ledger: Ledger) -> DataFrame:
    """Everybody has a current account, some market segments a savings account too."""
    day = F.col("c_custkey") % 365
    current = F.struct(
        (F.col("c_custkey") * 2 + 1).alias("id"),
        F.lit("Current").alias("name"),
        _money("c_acctbal").alias("opening_balance"),
        day.alias("day"),
    )
    savings = F.struct(
        (F.col("c_custkey") * 2 + 2).alias("id"),
        F.lit("Savings").alias("name"),
        F.lit(0).cast(MONEY).alias("opening_balance"),
        (day + 30).alias("day"),
    )
    saves = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")
    held = F.when(saves, F.array(current, savings)).otherwise(F.array(current))
    return ledger["customer"].select((F.col("c_custkey") + 1).alias("user_id"), F.explode(held).alias("a")).select(
        "a.id",
        "user_id",
        "a.name",
        "a.opening_balance",
        (_first_day(ledger) + days(F.col("a.day"))).alias("created_on"),
    )


def transactions(ledger: Ledger) -> DataFrame:
    key = F.col("o_orderkey")
    return ledger["orders"].select(
        (key + 1).alias("id"),
        (F.col("o_custkey") + 1).alias("creator_id"),
        F.col("o_orderpriority").alias("category"),
        (F.col("o_orderstatus") == "P").alias("is_income"),
        (key % 10 != 0).alias("include_in_reports"),
        F.when(key % 4 != 0, F.concat(F.lit("order "), _text("o_orderkey"))).alias("description"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("for "), F.col("o_orderpriority"))).alias("notes"),
        F.col("o_orderdate").alias("created_on"),
    )


def slots(ledger: Ledger) -> DataFrame:
    """One row per order and line number; an order has at most seven.

    The lines are shuffled once, by order, which is what the sums, the places and a join to the order all need. Tasks are as many
    as the lines need: the size of what is shuffled, by which partitions are joined otherwise, is a fraction of what a task then holds.
    """
    tasks = max(ledger.spark.sparkContext.defaultParallelism, -(-ledger["lineitem"].count() // LINES_PER_TASK))
    lines = ledger["lineitem"].select("l_orderkey", "l_linenumber", _money("l_extendedprice").alias("price")).repartition(tasks, "l_orderkey")
    by_line = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("price").alias("to_pay"))
    order = Window.partitionBy("l_orderkey")
    return by_line.select(
        "l_orderkey",
        "l_linenumber",
        _money("to_pay").alias("to_pay"),
        F.row_number().over(order.orderBy("l_linenumber")).cast("bigint").alias("slot"),
        _money(F.sum("to_pay").over(order)).alias("total"),
    )


def _ordered_slots(ledger: Ledger) -> DataFrame:
    """The slots with their orders, which are brought to them; slots are in no table of their own, as one use each needs them."""
    return slots(ledger).join(ledger["orders"].hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def transaction_amounts(ledger: Ledger) -> DataFrame:
    slot, order = F.col("slot"), F.col("o_orderkey")
    cash, guest = (slot == 1) & (order % 13 == 0), slot == 5
    partner = (F.col("o_custkey") + (slot - 1) * 7) % _customers(ledger)
    one_pays = F.when(slot == 1, F.col("total")).otherwise(F.lit(0).cast(MONEY))
    paid = F.when(order % 2 == 0, one_pays).otherwise(F.col("to_pay"))
    surplus = F.when((order % 11 == 0) & (slot == 1), F.lit(1)).otherwise(F.lit(0))
    return (
        _ordered_slots(ledger)
        .select(
            (F.col("l_orderkey") * 10 + slot).alias("id"),
            (F.col("l_orderkey") + 1).alias("transaction_id"),
            F.when(~cash & ~guest, partner * 2 + 1).alias("account_id"),
            F.when(cash, F.lit("Cash")).when(guest, F.concat(F.lit("Guest "), _text("l_linenumber"))).alias("account_name"),
            F.col("to_pay").alias("amount_to_pay"),
            _money(paid + surplus).alias("amount_paid"),
            F.col("o_orderdate").alias("created_on"),
        )
    )


def transaction_tags(ledger: Ledger) -> DataFrame:
    """The words of the ordered parts, in two spellings.

    An id is made of line, part and place of the word, each as wide as the data needs.
    """
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    parts = ledger["part"].select(F.max("p_partkey") + 1).scalar()
    places = ledger["part"].select(F.max(F.size(F.split("p_name", " ")))).scalar()
    part_line = (line * parts + F.col("l_partkey")) * places
    spelled = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit(" "), F.upper("word"))).otherwise(F.col("word"))
    words = F.posexplode(F.split("p_name", " ")).alias("at", "word")
    # Names go to their transaction in one piece and become words there, so tasks grow behind the shuffle: they are as many as
    # the session says, not joined by the size of what is shuffled.
    tasks = int(ledger.spark.conf.get("spark.sql.shuffle.partitions"))
    named = (
        ledger["lineitem"]
        .join(ledger["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select((F.col("l_orderkey") + 1).alias("transaction_id"), "l_linenumber", part_line.alias("base"), "p_name")
        .repartition(tasks, "transaction_id")
    )
    return (
        named.select("transaction_id", "l_linenumber", "base", words)
        .groupBy("transaction_id", spelled.alias("tag"))
        .agg(F.min(F.col("base") + F.col("at")).alias("id"))
        .select("id", "transaction_id", "tag")
    )


def friends(ledger: Ledger) -> DataFrame:
    """Everybody befriends the neighbour 7 ids on, most segments 14 on, low nations 21 on."""
    steps = F.array_compact(
        F.array(
            F.lit(7),
            F.when(F.col("c_mktsegment") != "BUILDING", F.lit(14)),
            F.when(F.col("c_nationkey") < 12, F.lit(21)),
        )
    )
    edge = ledger["customer"].select(F.col("c_custkey").alias("u"), F.explode(steps).alias("step"))
    edge = edge.withColumn("v", (F.col("u") + F.col("step")) % _customers(ledger))
    forward = F.col("u") % 2 == 0
    return edge.select(
        (F.when(forward, F.col("u")).otherwise(F.col("v")) + 1).alias("user_id"),
        (F.when(forward, F.col("v")).otherwise(F.col("u")) + 1).alias("friend_id"),
        (_first_day(ledger) + days(F.col("u") % 700)).alias("created_on"),
    )


def friend_requests(ledger: Ledger) -> DataFrame:
    key = F.col("c_custkey")
    step = F.when(key % 20 == 0, F.lit(7)).otherwise(F.lit(5))
    return ledger["customer"].select(
        (key + 1).alias("user_id"),
        ((key + step) % _customers(ledger) + 1).alias("friend_id"),
        (_first_day(ledger) + days(key % 500)).alias("created_on"),
    )


def friend_actions_from(events: DataFrame) -> DataFrame:
    """The friend log in the event table; also for streams."""
    step = F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 7 - 3
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("signup", "purchase"), "request")
        .when(kind == "click", "accept")
        .when(kind == "view", "reject")
        .otherwise("remove")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        (F.col("user_id") + 1).alias("actor_id"),
        (F.abs(F.col("user_id") + step) + 1).alias("target_id"),
        action.alias("action"),
    )


def friend_actions(ledger: Ledger) -> DataFrame:
    return friend_actions_from(ledger["events"])


def amount_changes(ledger: Ledger) -> DataFrame:
    """Every amount is entered; who owes pays 10 more; what was overpaid or small is then taken out."""
    paid, to_pay = F.col("amount_paid"), F.col("amount_to_pay")
    nobody, nothing = F.lit(None).cast("bigint"), F.lit(None).cast(MONEY)
    owed, more = paid < to_pay, _money(paid + 10)

    def change(kind: int, op: str, wait: int, old: tuple[Column, Column], new: tuple[Column, Column]) -> Column:
        return F.struct(
            (F.col("id") * 4 + kind).alias("change_id"),
            (F.col("created_on") + days(F.lit(wait))).alias("changed_on"),
            F.lit(op).alias("op"),
            F.col("transaction_id"),
            old[0].alias("old_account_id"),
            old[1].alias("old_paid"),
            new[0].alias("new_account_id"),
            new[1].alias("new_paid"),
            F.col("is_income"),
        )

    account = F.col("account_id")
    taken_out = (paid > to_pay) | (owed & (to_pay < 20000))
    changes = F.array_compact(
        F.array(
            change(1, "I", 0, (nobody, nothing), (account, paid)),
            F.when(owed, change(2, "U", 1, (account, paid), (account, more))),
            F.when(taken_out, change(3, "D", 2, (account, F.when(owed, more).otherwise(paid)), (nobody, nothing))),
        )
    )
    directions = ledger["transactions"].select(F.col("id").alias("transaction_id"), "is_income")
    rows = ledger["transaction_amounts"].join(directions, "transaction_id")
    return rows.select(F.explode(changes).alias("c")).select("c.*")


def transaction_patches(ledger: Ledger) -> DataFrame:
    """One edit for every transaction; most fields of most edits are not given."""
    key, category = F.col("id"), F.col("category")
    return ledger["transactions"].select(
        key.alias("transaction_id"),
        F.col("creator_id").alias("user_id"),
        F.when((category == "3-MEDIUM") & F.col("is_income"), "Adjusted").alias("category"),
        F.when(key % 17 == 0, ~F.col("is_income")).alias("is_income"),
        F.when(key % 51 == 0, F.lit(False)).alias("include_in_reports"),
        F.when(key % 68 == 0, "").alias("description"),
        F.when(category == "4-NOT SPECIFIED", "edited").alias("notes"),
        ((category == "2-HIGH") | ((category == "1-URGENT") & F.col("is_income"))).alias("replace_amounts"),
    )


def amount_patches(ledger: Ledger) -> DataFrame:
    """High-priority lists: the first participant takes over the second's part; incomes get a late guest.

    The others get a last row that breaks a rule, each kind of breach in turn.
    """
    high = ledger["transactions"].where("category = '2-HIGH'").select(
        F.col("id").alias("transaction_id"), "creator_id", "is_income", "notes"
    )
    rows = ledger["transaction_amounts"].join(high, "transaction_id")
    slot = F.col("id") % 10
    second = rows.where(slot == 2).select(
        "transaction_id", F.col("amount_to_pay").alias("more_to_pay"), F.col("amount_paid").alias("more_paid")
    )
    first = slot == 1
    listed = rows.where(slot != 2).join(second, "transaction_id", "left").select(
        "transaction_id",
        slot.cast("int").alias("position"),
        "id",
        F.lit(None).cast("bigint").alias("account_id"),
        F.lit(None).cast("string").alias("account_name"),
        F.when(first, _money(F.col("amount_to_pay") + F.coalesce("more_to_pay", F.lit(0)))).alias("amount_to_pay"),
        F.when(first, _money(F.col("amount_paid") + F.coalesce("more_paid", F.lit(0)))).alias("amount_paid"),
    )
    key, income, noted = F.col("transaction_id"), F.col("is_income"), F.col("notes").isNotNull()
    kind = F.when(~income & ~noted, key % 4)
    stranger = (F.col("creator_id") + 2) % _customers(ledger) * 2 + 1
    late = high.select(
        "transaction_id",
        F.lit(100).alias("position"),
        F.when(kind == 0, key * 10 + 1).alias("id"),
        F.when(~income & noted, stranger)
        .when(kind == 1, F.col("creator_id") * 2 - 1)
        .when(kind == 2, key + _customers(ledger) * 2)
        .alias("account_id"),
        F.when(income | (kind == 3), "Late guest").when(kind == 1, "Twice").alias("account_name"),
        F.lit(0).cast(MONEY).alias("amount_to_pay"),
        F.when(F.coalesce(kind, F.lit(0)) != 3, F.lit(0).cast(MONEY)).alias("amount_paid"),
    )
    return listed.unionByName(late)


def edit_steps(ledger: Ledger) -> DataFrame:
    """Three edits of every transaction: the one of `transaction_patches`, then one without effect on the amounts, refused where the
    category is 2-HIGH, then a list of the first amount alone."""
    first = ledger["transaction_patches"].withColumn("seq", F.col("transaction_id") * 4 + 1)
    key, none = F.col("transaction_id"), {f: F.lit(None).cast(t) for f, t in first.drop("seq").dtypes if f not in ("transaction_id", "user_id")}
    bare = first.select("transaction_id", F.col("user_id")).withColumns(none)
    high = ledger["transactions"].select(F.col("id").alias("transaction_id"), (F.col("category") == "2-HIGH").alias("_high"))
    second = bare.join(high, "transaction_id").withColumns({"seq": key * 4 + 2, "replace_amounts": F.coalesce("_high", F.lit(False))}).drop("_high")
    third = bare.withColumns({"seq": key * 4 + 3, "replace_amounts": F.lit(True)})
    return first.unionByName(second).unionByName(third)


def edit_step_amounts(ledger: Ledger) -> DataFrame:
    """The lists of `edit_steps`: those of `amount_patches`, one amount that doesn't balance, and the first stored amount as it is."""
    first = ledger["amount_patches"].withColumn("seq", F.col("transaction_id") * 4 + 1)
    none = {f: F.lit(None).cast(t) for f, t in ledger["amount_patches"].dtypes if f not in ("transaction_id", "position", "id")}
    keys = ledger["transactions"].select(F.col("id").alias("transaction_id"), F.lit(1).alias("position"), "category")
    second = keys.where("category = '2-HIGH'").withColumns(
        none | {"id": F.lit(None).cast("bigint"), "seq": F.col("transaction_id") * 4 + 2, "account_name": F.lit("Cash"), "amount_to_pay": F.lit(1).cast(MONEY), "amount_paid": F.lit(2).cast(MONEY)}
    )
    third = keys.withColumns(none | {"id": F.col("transaction_id") * 10 - 9, "seq": F.col("transaction_id") * 4 + 3})
    return first.unionByName(second.drop("category")).unionByName(third.drop("category"))


def tag_additions(ledger: Ledger) -> DataFrame:
    """Each amount brings its transaction's category as a tag, and each tag is sent again in capitals."""
    header = ledger["transactions"].select(F.col("id").alias("transaction_id"), "creator_id", "category")
    slot = F.col("id") % 10
    named = (
        F.when(slot == 1, F.col("category"))
        .when(slot == 2, F.concat(F.lit("\t"), F.lower("category"), F.lit(" ")))
        .when(slot == 5, F.lit(""))
        .otherwise(F.concat(F.lit("slot "), slot.cast("string")))
    )
    new = ledger["transaction_amounts"].join(header, "transaction_id").select(
        (F.col("id") * 2).alias("seq"), F.col("creator_id").alias("user_id"), "transaction_id", named.alias("tag")
    )
    again = ledger["transaction_tags"].join(header, "transaction_id").select(
        (F.col("id") * 2 + 1).alias("seq"),
        F.col("creator_id").alias("user_id"),
        "transaction_id",
        F.concat(F.upper("tag"), F.lit(" ")).alias("tag"),
    )
    return new.unionByName(again)


def tag_removals(ledger: Ledger) -> DataFrame:
    """Every tag is asked to be removed; those in small letters by a wrong transaction."""
    header = ledger["transactions"].select(F.col("id").alias("transaction_id"), "creator_id")
    capital = F.col("tag") == F.upper("tag")
    return (
        ledger["transaction_tags"]
        .withColumnRenamed("id", "tag_id")
        .withColumn("transaction_id", F.col("transaction_id") + F.when(capital, F.lit(0)).otherwise(F.lit(1)))
        .join(header, "transaction_id")
        .select(F.col("tag_id").alias("seq"), F.col("creator_id").alias("user_id"), "transaction_id", "tag_id")
    )


def account_requests(ledger: Ledger) -> DataFrame:
    """Each order opens an account named after its priority; some for nobody, some without a name."""
    status = F.col("o_orderstatus")
    return ledger["orders"].select(
        (F.col("o_orderkey") + 1).alias("seq"),
        F.col("o_orderdate").alias("opened_on"),
        F.when(F.col("o_totalprice") > 450000, F.lit(0).cast("bigint"))
        .when(F.col("o_totalprice") < 20000, F.col("o_custkey") + 1 + _customers(ledger))
        .otherwise(F.col("o_custkey") + 1)
        .alias("user_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(status == "F", _money("o_totalprice")).when(status == "P", -_money("o_totalprice")).alias("initial_balance"),
    )


def account_renames(ledger: Ledger) -> DataFrame:
    """Each amount's creator renames the account it uses, own or not."""
    header = ledger["transactions"].select(F.col("id").alias("transaction_id"), "creator_id", "category")
    name = F.when(F.col("category") == "5-LOW", F.lit("")).otherwise(F.concat(F.lit("Purse "), F.col("category")))
    return (
        ledger["transaction_amounts"]
        .where("account_id is not null")
        .join(header, "transaction_id")
        .select(F.col("id").alias("seq"), F.col("creator_id").alias("user_id"), "account_id", name.alias("name"))
    )


def account_closures(ledger: Ledger) -> DataFrame:
    """BUILDING customers close their current account twice; the others try a neighbour's."""
    key = F.col("c_custkey")
    stranger = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0)).otherwise(F.lit(1))
    return ledger["customer"].select(
        F.explode(F.array(key * 2, key * 2 + 1)).alias("seq"),
        (key + 1 + stranger).alias("user_id"),
        (key * 2 + 1).alias("account_id"),
    )


def new_friend_requests(ledger: Ledger) -> DataFrame:
    """Each order asks a customer up to 15 ids on for friendship, by name or by e-mail."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    target = (F.col("o_custkey") + key % 16) % _customers(ledger)
    asked = ledger["orders"].withColumn("id", target + 1).join(ledger["users"].drop("created_on"), "id")
    identifier = (
        F.when(F.col("o_totalprice") < 50000, F.concat(F.lit("nobody_"), F.col("username")))
        .when(status == "P", F.col("email"))
        .when(status == "F", F.upper("username"))
        .otherwise(F.col("username"))
    )
    return asked.select(
        (key + 1).alias("seq"), (F.col("o_custkey") + 1).alias("user_id"), identifier.alias("identifier")
    )


def friend_responses(ledger: Ledger) -> DataFrame:
    """Each request is answered by its receiver, then again; each friend answers a request never sent."""
    day = F.dayofmonth("created_on")
    answered = ledger["friend_requests"].select(
        F.explode(F.array(F.col("user_id") * 4, F.col("user_id") * 4 + 1)).alias("seq"),
        (F.col("created_on") + days(F.lit(3))).alias("responded_on"),
        F.col("friend_id").alias("user_id"),
        F.col("user_id").alias("friend_id"),
        F.when(day <= 20, "accept").when(day <= 27, "reject").otherwise("later").alias("action"),
    )
    stray = ledger["friends"].groupBy("user_id", "friend_id").agg(F.min("created_on").alias("created_on")).select(
        (F.col("user_id") * (_customers(ledger) + 1) + F.col("friend_id")).alias("base"), "user_id", "friend_id", "created_on"
    )
    stray = stray.select(
        (F.col("base") * 4 + 2).alias("seq"),
        F.col("created_on").alias("responded_on"),
        "user_id",
        "friend_id",
        F.lit("accept").alias("action"),
    )
    return answered.unionByName(stray)


def friend_removals(ledger: Ledger) -> DataFrame:
    """Each sender of a request ends the friendship with the receiver, who then tries the same."""
    sent = F.col("user_id") * 2
    both = F.array(
        F.struct(sent.alias("seq"), F.col("user_id").alias("a"), F.col("friend_id").alias("b")),
        F.struct((sent + 1).alias("seq"), F.col("friend_id").alias("a"), F.col("user_id").alias("b")),
    )
    return ledger["friend_requests"].select(F.explode(both).alias("r")).select(
        "r.seq", F.col("r.a").alias("user_id"), F.col("r.b").alias("friend_id")
    )


def leaving_users(ledger: Ledger) -> DataFrame:
    return ledger["customer"].where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1).alias("user_id"))


def new_users(ledger: Ledger) -> DataFrame:
    """Each order registers a user: new, known, too short, badly written or with a bad e-mail."""
    number, kind = _text("o_custkey"), F.col("o_orderpriority")
    name = (
        F.when(kind == "1-URGENT", F.concat(F.lit("New_User_"), number))
        .when(kind == "2-HIGH", F.concat(F.lit("CUSTOMER_"), F.lpad(number, 9, "0")))
        .when(kind == "3-MEDIUM", F.lit("ab"))
        .when(kind == "4-NOT SPECIFIED", F.concat(F.lit("user "), number))
        .otherwise(F.concat(F.lit("other_"), number))
    )
    status = F.col("o_orderstatus")
    email = F.concat(
        F.lit("u"),
        number,
        F.when(status == "O", F.lit("..x@example.com"))
        .when(kind == "5-LOW", F.lit("+low@mail.example.org"))
        .otherwise(F.lit("@mail.example.org")),
    )
    return ledger["orders"].select((F.col("o_orderkey") + 1).alias("seq"), name.alias("username"), email.alias("email"))


def session_claims(ledger: Ledger) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    name = F.concat(F.lit("customer_"), _text("user_id"))
    return ledger["events"].select(
        key.alias("session_id"),
        (F.col("user_id") + 1 + F.when(F.col("value") > 55, _customers(ledger)).otherwise(F.lit(0))).alias("user_id"),
        F.when(F.col("value") >= 0.5, name).otherwise(F.lit("")).alias("user_name"),
        F.when((kind != "error") | (F.col("value") >= 1), F.concat(name, F.lit("@example.com"))).alias("email"),
        F.col("ts").alias("issued_at"),
        (F.col("ts") + days(key % 30)).alias("expires_at"),
        (kind == "signup").alias("refresh"),
    )


def user_modified(ledger: Ledger) -> DataFrame:
    return (
        ledger["events"]
        .where("event_type = 'error' and value > 20")
        .groupBy((F.col("user_id") + 1).alias("user_id"))
        .agg(F.max("ts").alias("modified_on"))
    )


def filter_texts(ledger: Ledger) -> DataFrame:
    """A query string's filters for every order, as texts; some are none or make no sense."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    page = F.when(key % 11 == 0, "").when(key % 11 == 1, "abc").when(key % 11 == 2, "0").when(key % 11 == 3, "-3")
    start = F.when(key % 13 == 0, "1997-13-01").when(key % 13 == 1, "1997-02-03T04:05:06+02:00").when(key % 13 == 2, "yesterday")
    return ledger["orders"].select(
        key.alias("seq"),
        (F.col("o_custkey") + 1).alias("user_id"),
        page.when(key % 11 == 4, F.lit(" 12abc")).otherwise((key % 50 + 1).cast("string")).alias("page"),
        F.when(key % 7 == 0, "5.9").when(key % 7 == 1, "many").alias("limit"),
        start.when(key % 13 == 3, "1996-01-01T00:00:00.500Z").otherwise(day).alias("start_date"),
        F.when(key % 3 == 0, F.concat(day, F.lit("T23:59:59-05:30"))).alias("end_date"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(key % 17 == 0, "1e3").when(key % 17 == 1, "x7").otherwise((F.col("o_custkey") * 2 + 1).cast("string")).alias("account_id"),
        F.when(key % 19 == 0, F.array(F.lit("red"), F.lit("")))
        .when(key % 19 > 13, F.array(F.lit("red"), F.col("o_orderstatus")))
        .when(key % 19 > 9, F.array(F.lit("red")))
        .alias("tags"),
    )


# Bodies no client of ours sends, each with what is wrong with its shape; the requests of one order in FAULTY_EVERY
# carry each of them. {own} and {stranger} are accounts.
FAULTY_EVERY = 101
_ONE = '[{"accountName":"x","amountToPay":5,"amountPaid":5}]'
FAULTY_BODIES = [
    ("not json", "not_json"),
    ('["category"]', "bad_type"),
    ('{"category":7,"amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","isIncome":"yes","amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","includeInReports":0,"amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","tags":"solo","amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","tags":["a",1],"amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","notes":null,"amounts":%s}' % _ONE, "bad_type"),
    ('{"category":"c","amounts":{"accountId":1}}', "bad_type"),
    ('{"category":"c","amounts":[7]}', "bad_type"),
    ('{"category":"c","amounts":[{"accountName":"x","amountToPay":"5","amountPaid":5}]}', "bad_type"),
    ('{"category":"c","amounts":[{"accountName":"x","accountId":"abc","amountToPay":5,"amountPaid":5}]}', "bad_type"),
    ('{"category":"c","amounts":[{"accountId":1.5,"amountToPay":5,"amountPaid":5}]}', "bad_type"),
    ('{"category":"c","amounts":[{"accountName":"x","amountPaid":5}]}', "no_amount"),
    ('{"category":"c","amounts":[{"accountId":9223372036854775808,"amountToPay":5,"amountPaid":5}]}', "too_large"),
    ('{"category":"c","amounts":[{"accountName":"x","amountToPay":1e20,"amountPaid":5}]}', "too_large"),
    ('{"category":"c","amounts":[{"accountName":"x","amountToPay":5,"amountPaid":1.23456}]}', "too_precise"),
    # Numbers written in other ways are the same numbers.
    ('{"category":"c","amounts":[{"accountId":{own}.0,"amountToPay":5.00000,"amountPaid":50e-1}]}', None),
    ('{"category":"c","amounts":[{"accountId":{own}e0,"accountName":"x","amountToPay":5,"amountPaid":5}]}', None),
    ('{"category":"c","amounts":[{"accountId":{stranger}.0,"accountName":"x","amountToPay":5,"amountPaid":5}]}', None),
    ('{"category":"c","amounts":[{"accountId":{stranger}e0,"amountToPay":5,"amountPaid":5}]}', None),
]


def split_requests(ledger: Ledger) -> DataFrame:
    """A create request, as JSON, for every order line: sound ones and every kind of faulty one."""
    slot, status, share = F.col("slot"), F.col("o_orderstatus"), F.col("to_pay")
    customers = _customers(ledger)
    own = F.col("o_custkey") * 2 + 1

    def account_of(step: int) -> Column:
        return (F.col("o_custkey") + step) % customers * 2 + 1

    first_id = F.when(slot == 6, F.lit(None).cast("bigint")).otherwise(own)
    first_name = F.when(slot == 6, "Cash").when((slot == 1) & (status == "F"), "Mine")
    second_id = (
        F.when(slot == 2, account_of(7))
        .when(slot == 3, account_of(3))
        .when(slot == 4, own + customers * 2)
    )
    second_name = F.when(second_id.isNull() & ~((slot == 5) & (status == "O")), F.lit("Guest"))
    negative = (slot == 6) & (status == "P")
    surplus = F.when((slot == 5) & (status == "P"), F.lit(5)).otherwise(F.lit(0))

    def amount(account: Column, name: Column, to_pay: Column, paid: Column) -> Column:
        return F.struct(
            account.alias("accountId"),
            name.alias("accountName"),
            _money(to_pay).alias("amountToPay"),
            _money(paid).alias("amountPaid"),
        )

    two = F.array(
        amount(first_id, first_name, share - 1, share + surplus),
        amount(second_id, second_name, F.when(negative, F.lit(-1)).otherwise(F.lit(1)), F.lit(0)),
    )
    body = F.struct(
        F.when((slot == 7) & (status == "F"), F.lit("")).otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(status != "F", status == "P").alias("isIncome"),
        F.when(slot == 2, F.lit(False)).alias("includeInReports"),
        F.when(slot != 3, F.concat(F.lit("line "), _text("l_linenumber"))).alias("description"),
        F.when(slot == 1, F.lit("")).when(slot == 2, F.lit("shared")).alias("notes"),
        F.when(slot != 7, two).otherwise(F.slice(two, 1, 0)).alias("amounts"),
        F.when(slot < 3, F.array(F.lit("bill"), F.lit(" Bill"), status)).alias("tags"),
    )
    # One look into a list: a choice for each kind took as long as all the rest.
    kind, faulty = F.col("l_orderkey") % FAULTY_EVERY, F.array(*[F.lit(body) for body, _ in FAULTY_BODIES])
    spelled = F.replace(F.get(faulty, kind.cast("int")), F.lit("{own}"), own.cast("string"))
    spelled = F.replace(spelled, F.lit("{stranger}"), account_of(3).cast("string"))
    text = F.when(kind.between(0, len(FAULTY_BODIES) - 1), spelled).otherwise(F.to_json(body))
    return (
        _ordered_slots(ledger)
        .select(
            (F.col("l_orderkey") * 10 + slot).alias("request_id"),
            (F.col("o_custkey") + 1).alias("user_id"),
            F.col("o_orderdate").alias("received_on"),
            text.alias("body"),
        )
    )


TABLES: dict[str, Callable[[Ledger], DataFrame]] = {
    make.__name__: make
    for make in (
        users,
        accounts,
        transactions,
        slots,
        transaction_amounts,
        transaction_tags,
        friends,
        friend_requests,
        friend_actions,
        amount_changes,
        transaction_patches,
        amount_patches,
        edit_steps,
        edit_step_amounts,
        tag_additions,
        tag_removals,
        filter_texts,
        account_requests,
        account_renames,
        account_closures,
        new_friend_requests,
        friend_responses,
        friend_removals,
        leaving_users,
        new_users,
        session_claims,
        user_modified,
        split_requests,
    )
}
