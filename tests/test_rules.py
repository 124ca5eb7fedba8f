"""Rules whose cases the given data does not hold, on hand-made tables."""

import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pursebook.functions import times
from pursebook.functions.text import is_email, is_username, same_tag
from pursebook.operators import accounts as account_ops
from pursebook.operators import balances, edits, friends, requests, search, splits, tags, users

AMOUNTS = (
    "id long, transaction_id long, account_id long, account_name string, amount_to_pay decimal(19,4), "
    "amount_paid decimal(19,4), created_on timestamp_ntz"
)
HEADERS = (
    "id long, creator_id long, category string, is_income boolean, include_in_reports boolean, "
    "description string, notes string, created_on timestamp_ntz"
)
PATCHES = (
    "transaction_id long, user_id long, category string, is_income boolean, include_in_reports boolean, "
    "description string, notes string, replace_amounts boolean"
)
AMOUNT_PATCHES = (
    "transaction_id long, position int, id long, account_id long, account_name string, "
    "amount_to_pay decimal(19,4), amount_paid decimal(19,4)"
)
ACCOUNTS = "id long, user_id long, name string, opening_balance decimal(19,4), created_on timestamp_ntz"
EDGES = "user_id long, friend_id long, created_on timestamp_ntz"
USERS = "id long, username string, email string, created_on timestamp_ntz"
DAY = datetime(2024, 1, 1)


def amount(row_id, transaction, account, name, to_pay, paid):
    return (row_id, transaction, account, name, Decimal(to_pay), Decimal(paid), DAY)


def header(row_id, creator=1, income=False):
    return (row_id, creator, "food", income, True, None, None, DAY)


def answers(frame, key, value):
    return {row[key]: row[value] for row in frame.collect()}


@pytest.fixture
def people(table):
    """Users 1 to 4 with an account each (id = 10 x user); 1 and 2 are friends, stored both ways."""
    return {
        "accounts": table(ACCOUNTS, [(10 * u, u, f"acc{u}", Decimal(100), DAY) for u in (1, 2, 3, 4)]),
        "friends": table(EDGES, [(1, 2, DAY + timedelta(days=1)), (2, 1, DAY)]),
        "users": table(USERS, [(u, f"user_{u}", f"u{u}@x.org", DAY) for u in (1, 2, 3, 4)]),
    }


def test_row_checks_give_the_first_reason(table):
    rows = table(
        AMOUNTS,
        [
            amount(1, 1, None, None, 1, 1),
            amount(2, 1, 10, "x", 1, 1),
            amount(3, 1, 10, None, -1, 1),
            amount(4, 1, 20, None, 1, -1),
            amount(5, 2, 10, None, 1, 1),
            amount(6, 2, 10, None, 1, 1),
            amount(7, 2, None, "Bob", 1, 1),
            amount(8, 2, None, "Bob", 1, 1),
            amount(9, 3, 10, None, 0, 0),
        ],
    )
    assert answers(splits.amount_row_checks(rows), "id", "reason") == {
        1: "neither",
        2: "both",
        3: "negative_share",
        4: "negative_payment",
        5: "repeated",
        6: "repeated",
        7: "repeated",
        8: "repeated",
        9: "ok",
    }


def test_split_verdicts_in_order(table, people):
    cases = {
        1: ([], "empty"),
        2: ([(10, None, -1, -1)], "negative"),
        3: ([(10, None, 5, 5), (None, None, 5, 5), (99, None, 1, 0)], "neither"),
        4: ([(99, None, 5, 5), (None, None, 5, 5)], "unknown_account"),
        5: ([(10, "x", 5, 5)], "both"),
        6: ([(10, None, 5, 5), (30, None, 5, 6)], "no_access"),
        7: ([(10, None, 5, 5), (20, None, 5, "5.01")], "unbalanced"),
        8: ([(10, None, 5, 5), (20, None, 5, "5.0099")], "ok"),
        9: ([(20, None, 5, 5)], "no_self"),
        10: ([(None, "Bob", 5, 5)], "no_self"),
    }
    rows, number = [], 0
    for transaction, (parts, _) in cases.items():
        for account, name, to_pay, paid in parts:
            number += 1
            rows.append(amount(number, transaction, account, name, to_pay, paid))
    verdicts = splits.split_validation(
        table(HEADERS, [header(t) for t in cases]), table(AMOUNTS, rows), people["accounts"], people["friends"]
    )
    assert answers(verdicts, "transaction_id", "verdict") == {t: verdict for t, (_, verdict) in cases.items()}
    assert answers(verdicts, "transaction_id", "reasons")[6] == ["no_access", "unbalanced"]


def test_remaining_follows_a_given_bill(table):
    rows = table(
        AMOUNTS,
        [
            amount(1, 1, 10, None, 60, 100),
            amount(2, 1, 20, None, 40, 0),
            amount(3, 2, 10, None, 60, 100),
            amount(4, 2, 20, None, 30, 0),
        ],
    )
    bills = table("transaction_id long, total decimal(19,4)", [(1, Decimal(100)), (2, Decimal(100))])
    placed = {r["id"]: (r["remaining_to_pay"], r["remaining_paid"], r["ok"]) for r in splits.split_remaining(rows, bills).collect()}
    assert placed == {
        1: (100, 100, True),
        2: (40, 0, True),
        3: (100, 100, True),
        4: (40, 0, False),
    }


def test_participant_rules(table, people):
    rows = table(
        AMOUNTS,
        [
            amount(1, 1, 20, None, 0, 0),
            amount(2, 1, 10, None, 0, 0),
            amount(3, 2, 10, None, 1, 1),
            amount(4, 2, 10, None, 1, 1),
            amount(5, 2, None, "", 1, 1),
            amount(6, 2, 30, None, 1, 1),
            amount(7, 3, 10, None, 1, 1),
        ],
    )
    found = splits.split_participant_rules(
        table(HEADERS, [header(t) for t in (1, 2, 3, 4)]), rows, people["accounts"], people["friends"]
    )
    assert answers(found, "transaction_id", "reasons") == {
        1: ["no_amount", "first_not_own"],
        2: ["account_twice", "guest_without_name", "not_offered"],
        3: [],
        4: ["no_participants"],
    }


def test_edits_are_refused_as_a_whole(table, people):
    rows = table(AMOUNTS, [amount(10 * t + 1, t, 10, None, 100, 100) for t in range(1, 10)])
    headers = table(HEADERS, [header(t) for t in range(1, 10)])
    none = (None,) * 5

    def patch(t, replace=True, fields=none, user=1):
        return (t, user, *fields, replace)

    patches = table(
        PATCHES,
        [
            patch(1),
            patch(2),
            patch(3),
            patch(4, fields=("x", None, None, None, None)),
            patch(5, user=3),
            patch(6, replace=False, fields=(None, None, None, None, "")),
            patch(7),
            patch(8),
            patch(9, replace=False, fields=("rent", True, None, None, "paid")),
        ],
    )
    lists = table(
        AMOUNT_PATCHES,
        [
            (1, 1, 21, None, None, None, None),  # an amount of another transaction
            (2, 1, 21, None, "Bob", None, None),  # a name on an account row
            (3, 1, 31, 20, None, None, Decimal(40)),  # moved to a friend's account, paid twice patched
            (3, 2, 31, None, None, Decimal(50), Decimal(50)),
            (3, 3, None, None, "Bob", Decimal(50), Decimal(50)),
            (7, 1, None, 30, None, Decimal(1), Decimal(1)),
            (8, 1, None, 20, None, Decimal(1), None),
        ],
    )
    verdicts = edits.edit_verdicts(rows, patches, lists, people["accounts"], people["friends"])
    assert answers(verdicts, "transaction_id", "verdict") == {
        1: "foreign_id",
        2: "either_or",
        3: "ok",
        4: "delete_with_updates",
        5: "not_found",
        6: "empty_field",
        7: "no_access",
        8: "no_amount_paid",
        9: "ok",
    }
    no_tags = table("id long, transaction_id long, tag string", [])
    after = edits.edited_ledger(headers, rows, no_tags, patches, lists, verdicts)
    third = sorted((r["account_id"] or 0, r["account_name"], r["amount_paid"]) for r in after.amounts.where("transaction_id = 3").collect())
    assert third == [(0, "Bob", 50), (20, None, 50)]
    ninth = after.transactions.where("id = 9").first()
    assert (ninth["category"], ninth["is_income"], ninth["notes"]) == ("rent", True, "paid")
    assert after.amounts.where("transaction_id in (1, 2, 4, 5, 6, 7, 8, 9)").count() == 8


def test_edits_of_one_transaction_follow_each_other(table, people):
    """Each is judged on what the accepted ones before it left, and is applied by the other operators one at a time."""
    rows = table(AMOUNTS, [amount(10 * t + 1, t, 10, None, 100, 100) for t in range(1, 4)])
    none = (None,) * 5
    steps = [  # transaction, seq, editor, replaces, texts, list of (position, id, account, name, to pay, paid)
        (1, 1, 1, True, none, [(1, 11, None, None, Decimal(60), Decimal(60)), (2, None, 20, None, Decimal(40), Decimal(40))]),
        (1, 2, 1, True, none, [(1, 11, None, None, Decimal(50), None)]),  # doesn't balance
        (1, 3, 2, True, none, [(1, 11, 20, None, None, None)]),  # the friend, whom only the first edit let in, takes all
        (1, 4, 1, False, none, []),  # no longer theirs
        (1, 5, 2, True, none, [(1, 21, None, None, None, None)]),
        (1, 6, 2, True, none, []),
        (1, 7, 2, False, none, []),  # gone
        (2, 8, 2, False, none, []),
        (2, 9, 1, True, ("x", None, None, None, None), []),
        (2, 2, 1, False, ("", None, None, None, None), []),
        (4, 1, 1, False, none, []),  # no such transaction
    ]
    random.Random(3).shuffle(steps)
    patches = table("seq long, " + PATCHES, [(seq, t, user, *texts, replaces) for t, seq, user, replaces, texts, _ in steps])
    lists = table("seq long, " + AMOUNT_PATCHES, [(seq, t, *row) for t, seq, *_, listed in steps for row in listed])
    found = edits.edit_sequence(rows, patches, lists, people["accounts"], people["friends"])
    by_step = {(r["transaction_id"], r["seq"]): (r["verdict"], r["n_amounts"], r["paid"]) for r in found.collect()}
    assert by_step == {
        (1, 1): ("ok", 2, 100),
        (1, 2): ("unbalanced", 2, 100),
        (1, 3): ("ok", 1, 60),
        (1, 4): ("not_found", 1, 60),
        (1, 5): ("foreign_id", 1, 60),
        (1, 6): ("deleted", 0, 0),
        (1, 7): ("not_found", 0, 0),
        (2, 2): ("empty_field", 1, 100),
        (2, 8): ("not_found", 1, 100),
        (2, 9): ("delete_with_updates", 1, 100),
        (4, 1): ("not_found", 0, 0),
    }
    nothing = edits.edit_sequence(rows, patches.limit(0), lists, people["accounts"], people["friends"])
    assert nothing.collect() == []


def test_a_long_chain_of_edits(table, people):
    """Each edit takes one from what the one before left; every third is refused."""
    n = 3000
    rows = table(AMOUNTS, [amount(11, 1, 10, None, n, n)])
    patches = table("seq long, " + PATCHES, [(seq, 1, 1, *(None,) * 5, True) for seq in range(1, n)])
    lists = []
    for seq in range(1, n):
        left = Decimal(n - seq)
        lists.append((seq, 1, 1, 11, None, None, left, left if seq % 3 else left + 1))
    found = edits.edit_sequence(rows, patches, table("seq long, " + AMOUNT_PATCHES, lists), people["accounts"], people["friends"])
    for row in found.collect():
        seq = row["seq"]
        assert (row["verdict"], row["paid"]) == (("ok", n - seq) if seq % 3 else ("unbalanced", n - seq + 1))


def test_deletion_takes_balances_back(table, people):
    rows = table(AMOUNTS, [amount(1, 1, 10, None, 30, 30), amount(2, 2, 10, None, 5, 5)])
    headers = table(HEADERS, [header(1), header(2, income=True)])
    no_tags = table("id long, transaction_id long, tag string", [(1, 1, "a"), (2, 2, "b")])
    gone = edits.delete_transactions(headers, rows, no_tags, table("transaction_id long", [(1,)]))
    assert answers(gone.reversal, "account_id", "delta") == {10: 30}
    assert [r["id"] for r in gone.transactions.collect()] == [2]
    assert [r["id"] for r in gone.amounts.collect()] == [2]
    assert [r["tag"] for r in gone.tags.collect()] == ["b"]


def test_balance_moves_with_a_changed_account(table):
    changes = table(
        "change_id long, op string, transaction_id long, old_account_id long, old_paid decimal(19,4), "
        "new_account_id long, new_paid decimal(19,4)",
        [(1, "U", 1, 10, Decimal(5), 20, Decimal(7)), (2, "D", 1, None, Decimal(3), None, None)],
    )
    found = balances.balance_delta_from_changes(changes, table(HEADERS, [header(1)]))
    assert answers(found, "account_id", "delta") == {10: 5, 20: -7}


def test_tag_search_wants_every_different_tag(table):
    rows = table("id long, transaction_id long, tag string", [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 3, "A"), (5, 3, "b")])
    assert [r[0] for r in search.transactions_with_all_tags(rows, ["a", "b", "a"]).collect()] == [1]


def test_search_bounds_are_inclusive_and_pages_are_checked(table, people):
    rows = table(AMOUNTS, [amount(t, t, 10, None, 1, 1) for t in (1, 2, 3)])
    headers = table(HEADERS, [(t, 1, "food", False, True, None, None, DAY + timedelta(days=t)) for t in (1, 2, 3)])
    found = search.transaction_search(
        headers,
        rows,
        people["accounts"],
        user_id=1,
        start=(DAY + timedelta(days=1)).replace(tzinfo=UTC),
        end=DAY + timedelta(days=2),
        account_id=10,
    )
    assert [r["id"] for r in search.transaction_page(found).collect()] == [2, 1]
    assert search.transaction_page(found, page=2).collect() == []
    for page, limit in ((0, 5), (1, 0), (1.5, 5), (True, 5)):
        with pytest.raises(ValueError):
            search.transaction_page(found, page, limit)


def test_friends_stored_both_ways_count_once(people):
    listed = friends.friend_list(people["friends"], people["users"])
    assert sorted((r["user_id"], r["friend_id"], r["created_on"]) for r in listed.collect()) == [(1, 2, DAY), (2, 1, DAY)]
    assert [r["friend_id"] for r in friends.friend_list(people["friends"], people["users"], 2).collect()] == [1]


def test_the_picker_offers_friends_with_accounts(people, table):
    edges = people["friends"].unionByName(table(EDGES, [(5, 1, DAY)]))
    everybody = people["users"].unionByName(table(USERS, [(5, "user_5", "u5@x.org", DAY)]))
    picker = friends.friend_picker(edges, everybody, people["accounts"], 1)
    assert [(r["friend_id"], r["username"], r["account_id"]) for r in picker.collect()] == [(2, "user_2", 20)]
    directory = friends.friend_directory(edges, everybody, people["accounts"], 1)
    assert {r["friend_id"]: (r["accounts"], r["offered"]) for r in directory.collect()} == {2: (1, True), 5: (0, False)}


def test_admission_and_answers(table, people):
    asked = table(
        "seq long, user_id long, identifier string",
        [
            (1, 1, "nobody"),
            (2, 1, "USER_1"),
            (3, 1, "u2@x.org"),
            (4, 3, "user_4"),
            (5, 4, "u3@x.org"),
            (6, 1, "User_3"),
            (7, 1, ""),
        ],
    )
    pending = table(EDGES, [(3, 1, DAY)])
    found = friends.friend_request_admission(asked, people["users"], people["friends"], pending)
    assert answers(found, "seq", "verdict") == {
        1: "not_found",
        2: "to_oneself",
        3: "already_friends",
        4: "accepted",
        5: "pending",
        6: "pending",
        7: "empty",
    }
    answered = table(
        "seq long, responded_on timestamp_ntz, user_id long, friend_id long, action string",
        [(1, DAY, 3, 1, "accept"), (2, DAY, 1, 3, "reject"), (3, DAY, 1, 3, "accept"), (4, DAY, 1, 3, "later")],
    )
    done = friends.friend_request_resolution(pending, people["friends"], answered)
    assert answers(done.verdicts, "seq", "verdict") == {1: "not_found", 2: "rejected", 3: "not_found", 4: "bad_action"}
    assert done.requests.count() == 0 and done.friends.count() == 2


def test_user_deletion_reaches_everything(table, people):
    gone = friends.delete_users_cascade(
        people["users"], people["accounts"], people["friends"], table(EDGES, [(3, 1, DAY), (3, 4, DAY)]),
        table("user_id long", [(1,)]),
    )
    assert sorted(r["id"] for r in gone.users.collect()) == [2, 3, 4]
    assert gone.friends.count() == 0
    assert [(r["user_id"], r["friend_id"]) for r in gone.requests.collect()] == [(3, 4)]
    rows = account_ops.guests_instead(table(AMOUNTS, [amount(1, 1, 10, None, 1, 1), amount(2, 1, 20, None, 1, 1)]), gone.closed_accounts)
    assert sorted((r["id"], r["account_id"], r["account_name"]) for r in rows.collect()) == [(1, None, "acc1"), (2, 20, None)]


def test_one_viewer_sees_own_and_friends_accounts(people):
    balance = people["accounts"].select(F.col("id").alias("account_id"), F.col("opening_balance").alias("balance"))
    seen = account_ops.accounts_visible_to(1, people["accounts"], balance, people["friends"])
    assert sorted((r["account_id"], r["balance"], r["is_masked"]) for r in seen.collect()) == [(10, 100, False), (20, None, True)]


def test_wrongly_typed_requests_are_refused_whole(table):
    """Each field in turn has a type it must not have; nothing is coerced and no row comes out of them."""
    one = '"amounts": [{"accountName": "x", "amountToPay": 5, "amountPaid": 5}]'
    good = ['{"category": "c", %s}' % one, '{"category": "c", "amounts": [{"accountId": 3.0, "amountToPay": 5e0, "amountPaid": 0.5}]}']
    fields = ['"isIncome": "yes"', '"isIncome": 1', '"includeInReports": 0', '"category": 7', '"description": 1', '"notes": null', '"tags": "solo"', '"tags": [1]']
    amounts = ['{"accountId": "abc"}', '{"accountId": 1.5}', '{"accountId": true}', '{"accountName": 1}', '{"amountToPay": "5"}', '{"amountPaid": null}', "7", "[]"]
    bad = ['{"category": "c", %s, %s}' % (field, one) if "category" not in field else "{%s, %s}" % (field, one) for field in fields]
    bad += ['{"category": "c", "amounts": [%s]}' % amount for amount in amounts] + ['{"category": "c", "amounts": 5}', "[]", "7", "null"]
    broken = ["not json", "", '{"category": "c"', None]
    bodies = [*good, *bad, *broken]
    rows = [(i, 1, DAY, body) for i, body in enumerate(bodies)]
    flat = requests.flatten_requests(table("request_id long, user_id long, received_on timestamp_ntz, body string", rows))
    shapes = answers(flat.headers, "id", "shape")
    assert [shapes[i] for i in range(len(bodies))] == [None] * len(good) + ["bad_type"] * len(bad) + ["not_json"] * len(broken)
    assert {r["transaction_id"] for r in flat.amounts.collect()} == set(range(len(good)))


def test_numbers_are_taken_exactly_or_refused(table):
    """However a number is written it is the same one; what its column can't hold is refused by name and never becomes NULL."""
    amounts = [
        ('"accountId": 2.0, "accountName": "x", "amountToPay": 5, "amountPaid": 5', None, 2),
        ('"accountId": 1e0, "amountToPay": 5.00000, "amountPaid": 50e-1', None, 1),
        ('"accountId": 9223372036854775807, "amountToPay": 0, "amountPaid": 0', None, 2**63 - 1),
        ('"accountId": 9223372036854775808, "amountToPay": 0, "amountPaid": 0', "too_large", None),
        ('"accountId": 1e30, "amountToPay": 0, "amountPaid": 0', "too_large", None),
        ('"accountId": 0.0, "amountToPay": 0, "amountPaid": 0', "bad_account_id", 0),
        ('"accountId": 1, "amountToPay": 1e20, "amountPaid": 0', "too_large", 1),
        ('"accountId": 1, "amountToPay": 0, "amountPaid": 1e300', "too_large", 1),
        ('"accountId": 1, "amountToPay": 1.23456, "amountPaid": 0', "too_precise", 1),
        ('"accountId": 1, "amountToPay": 1.2345, "amountPaid": 1.2345000', None, 1),
        ('"accountId": 1, "amountToPay": -0.00001, "amountPaid": 0', "negative", 1),
    ]
    rows = [(i, 1, DAY, '{"category": "c", "amounts": [{%s}]}' % text) for i, (text, _, _) in enumerate(amounts)]
    flat = requests.flatten_requests(table("request_id long, user_id long, received_on timestamp_ntz, body string", rows))
    assert answers(flat.headers, "id", "shape") == {i: shape for i, (_, shape, _) in enumerate(amounts)}
    assert answers(flat.amounts, "transaction_id", "account_id") == {i: account for i, (_, _, account) in enumerate(amounts)}


def test_requests_with_gaps(table):
    bodies = [
        (1, '{"category": "food", "amounts": [{"accountId": 10, "amountToPay": 1.5, "amountPaid": 1.5}], "notes": ""}'),
        (2, "not json"),
        (3, '{"category": "", "amounts": []}'),
        (4, '{"category": "food", "amounts": []}'),
        (5, '{"category": "food", "amounts": [{"accountId": 10, "amountToPay": 1}]}'),
        (6, '{"category": "food", "tags": [""], "amounts": [{"accountId": 10, "amountToPay": 0, "amountPaid": 0}]}'),
        (7, '{"category": "food", "amounts": [{"accountName": "", "amountToPay": 0, "amountPaid": 0}]}'),
        (8, '{"category": "food", "amounts": [{"accountId": -1, "amountToPay": 0, "amountPaid": 0}]}'),
        (9, '{"category": "food", "description": "", "amounts": [{"accountId": 1, "amountToPay": 0, "amountPaid": 0}]}'),
    ]
    flat = requests.flatten_requests(
        table("request_id long, user_id long, received_on timestamp_ntz, body string", [(i, 1, DAY, b) for i, b in bodies])
    )
    assert answers(flat.headers, "id", "shape") == {
        1: None,
        2: "not_json",
        3: "no_category",
        4: "empty",
        5: "no_amount",
        6: "empty_tag",
        7: "empty_account_name",
        8: "bad_account_id",
        9: "empty_description",
    }
    first = flat.headers.where("id = 1").first()
    assert (first["is_income"], first["include_in_reports"], first["notes"]) == (False, True, None)


def test_tags_are_compared_trimmed_and_in_lower_case(table, people):
    stored = table("id long, transaction_id long, tag string", [(1, 1, " Food ")])
    visible = table("user_id long, transaction_id long", [(1, 1)])
    asked = table(
        "seq long, user_id long, transaction_id long, tag string",
        [(1, 1, 1, "\tFOOD"), (2, 1, 1, "Rent"), (3, 1, 1, "rent "), (4, 2, 1, "x"), (5, 1, 1, "")],
    )
    change = tags.add_tags(stored, asked, visible)
    assert answers(change.verdicts, "seq", "verdict") == {1: "exists", 2: "accepted", 3: "exists", 4: "not_found", 5: "empty"}
    assert sorted((r["id"], r["tag"]) for r in change.tags.collect()) == [(1, " Food "), (3, "Rent")]


def test_names_and_mails(table):
    texts = {
        "ab": (False, False),
        "abc": (True, False),
        "a" * 255: (True, False),
        "a" * 256: (False, False),
        "user name": (False, False),
        "abc\n": (False, False),
        "a.b+c@mail.example.org": (False, True),
        ".a@example.org": (False, False),
        "a..b@example.org": (False, False),
        "a@example": (False, False),
        "a@example.c": (False, False),
        "A@EXAMPLE.COM": (False, True),
        "a.@example.org": (False, False),
    }
    rows = table("text string", [(t,) for t in texts]).select("text", is_username(F.col("text")).alias("u"), is_email(F.col("text")).alias("e"))
    assert {r["text"]: (r["u"], r["e"]) for r in rows.collect()} == texts


def test_sessions(table, people):
    now = datetime(2024, 1, 10, 12, 0, 0, 700000)
    later, before = now + timedelta(days=1), now - timedelta(days=1)
    rows = [
        (1, 1, "n", "e", before, later, True),
        (2, 1, "n", "e", before, None, True),
        (3, 1, "n", "e", None, later, True),
        (4, 1, "n", "e", before, before, True),
        (5, 1, "n", "e", later, later, True),
        (6, 0, "n", "e", before, later, True),
        (7, 1, "", "e", before, later, True),
        (8, 1, "n", None, before, later, True),
        (9, 99, "n", "e", before, later, True),
        (10, 2, "n", "e", before, later, True),
        (11, 1, "n", "e", before, later, None),
        (12, 1, "n", "e", now.replace(microsecond=900000), now.replace(microsecond=100000), True),
        (13, 3, "n", "e", before, later, True),
    ]
    claims = table(
        "session_id long, user_id long, user_name string, email string, issued_at timestamp_ntz, "
        "expires_at timestamp_ntz, refresh boolean",
        rows,
    )
    changed = table(
        "user_id long, modified_on timestamp_ntz", [(2, now), (3, before.replace(microsecond=999999))]
    )
    verdicts = users.session_claims_audit(claims, people["users"], changed, times.moment(now), refresh_required=True)
    assert answers(verdicts, "session_id", "verdict") == {
        1: "valid",
        2: "no_expiry",
        3: "no_issue_time",
        4: "expired",
        5: "not_yet_valid",
        6: "missing_claims",
        7: "missing_claims",
        8: "missing_claims",
        9: "unknown_user",
        10: "user_changed",
        11: "not_refresh",
        12: "valid",
        13: "valid",
    }


def test_times_do_not_depend_on_the_session_zone(spark, table):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moments = [datetime(2024, 3, 10, 2, 30, 1, 5), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 999999)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = table("t timestamp_ntz", [(m,) for m in moments]).select(
            "t", times.hour_number("t").alias("hour"), times.second_number("t").alias("s"),
            times.month("t").alias("month"), (times.moment(moments[0]) == F.col("t")).alias("same"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for row in rows:
        since = row["t"] - datetime(1970, 1, 1)
        assert row["hour"] == since // timedelta(hours=1)
        assert row["s"] == since // timedelta(seconds=1)
        assert row["month"] == datetime(row["t"].year, row["t"].month, 1)
        assert row["same"] == (row["t"] == moments[0])


def test_same_tag_trims_what_the_client_trims(table):
    rows = table("tag string", [("　﻿A b \n",)]).select(same_tag("tag").alias("t"))
    assert rows.first()["t"] == "a b"
