"""Explicit schemas of the ledger tables; nothing is inferred at read time."""

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 4)
TOTAL = T.DecimalType(38, 4)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _TEXT, _FLAG, _TIME = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()

USERS = _table(id=_LONG, username=_TEXT, email=_TEXT, created_on=_TIME)

ACCOUNTS = _table(id=_LONG, user_id=_LONG, name=_TEXT, opening_balance=MONEY, created_on=_TIME)

TRANSACTIONS = _table(
    id=_LONG,
    creator_id=_LONG,
    category=_TEXT,
    is_income=_FLAG,
    include_in_reports=_FLAG,
    description=_TEXT,
    notes=_TEXT,
    created_on=_TIME,
)

AMOUNTS = _table(
    id=_LONG,
    transaction_id=_LONG,
    account_id=_LONG,
    account_name=_TEXT,
    amount_to_pay=MONEY,
    amount_paid=MONEY,
    created_on=_TIME,
)

TAGS = _table(id=_LONG, transaction_id=_LONG, tag=_TEXT)

FRIENDS = _table(user_id=_LONG, friend_id=_LONG, created_on=_TIME)

FRIEND_REQUESTS = _table(user_id=_LONG, friend_id=_LONG, created_on=_TIME)

FRIEND_ACTIONS = _table(seq=_LONG, ts=_TIME, actor_id=_LONG, target_id=_LONG, action=_TEXT)

AMOUNT_CHANGES = _table(
    change_id=_LONG,
    changed_on=_TIME,
    op=_TEXT,
    transaction_id=_LONG,
    old_account_id=_LONG,
    old_paid=MONEY,
    new_account_id=_LONG,
    new_paid=MONEY,
    is_income=_FLAG,
)

TRANSACTION_PATCHES = _table(
    transaction_id=_LONG,
    user_id=_LONG,
    category=_TEXT,
    is_income=_FLAG,
    include_in_reports=_FLAG,
    description=_TEXT,
    notes=_TEXT,
    replace_amounts=_FLAG,
)

AMOUNT_PATCHES = _table(
    transaction_id=_LONG,
    position=T.IntegerType(),
    id=_LONG,
    account_id=_LONG,
    account_name=_TEXT,
    amount_to_pay=MONEY,
    amount_paid=MONEY,
)

SESSION_CLAIMS = _table(
    session_id=_LONG,
    user_id=_LONG,
    user_name=_TEXT,
    email=_TEXT,
    issued_at=_TIME,
    expires_at=_TIME,
    refresh=_FLAG,
)

USER_MODIFIED = _table(user_id=_LONG, modified_on=_TIME)

REQUESTS = _table(request_id=_LONG, user_id=_LONG, received_on=_TIME, body=_TEXT)
