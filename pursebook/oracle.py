"""The SQL each registered query must agree with, over the same given tables.

VIEWS restates the derived ledger; CHECKS restates the operators. A statement is put together from
the views it needs.
"""

import re

from pursebook.sources.derive import FAULTY_BODIES, FAULTY_EVERY

# The faulty bodies whose types are right: the account (own, stranger's or none), name, share and payment they hold.
READABLE = {
    13: ("NULL", "'x'", "NULL", "5"),
    14: ("NULL", "NULL", "5", "5"),
    15: ("NULL", "'x'", "NULL", "5"),
    16: ("NULL", "'x'", "5", "NULL"),
    17: ("'own'", "NULL", "5", "5"),
    18: ("'own'", "'x'", "5", "5"),
    19: ("'stranger'", "'x'", "5", "5"),
    20: ("'stranger'", "NULL", "5", "5"),
}
_READABLE = ", ".join(f"({kind}, {', '.join(values)})" for kind, values in READABLE.items())
_KINDS = ", ".join(map(str, READABLE))
_SHAPES = " ".join(f"WHEN {kind} THEN '{shape}'" for kind, (_, shape) in enumerate(FAULTY_BODIES) if shape)
DAY0 = "(SELECT min(o_orderdate) FROM orders)"
CUSTOMERS = "(SELECT count(*) FROM customer)"
MONEY = "DECIMAL(19,4)"
TOTAL = "DECIMAL(38,4)"
SPACES = "chr(9) || chr(10) || ' '"


def money(text: str) -> str:
    return f"CAST({text} AS {MONEY})"


def total(text: str) -> str:
    return f"CAST(sum({text}) AS {TOTAL})"


def after_day0(days: str) -> str:
    return f"{DAY0} + INTERVAL '1' DAY * CAST({days} AS INT)"


def _whole(text: str) -> str:
    """The whole number a text begins with."""
    return f"TRY_CAST(nullif(regexp_extract({text}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


def same_tag(text: str) -> str:
    return f"lower(trim({text}, {SPACES}))"


VIEWS = {
    "users": f"""
        SELECT c_custkey + 1 AS id, lower(replace(c_name, '#', '_')) AS username,
          concat(lower(replace(c_name, '#', '_')), '@example.com') AS email,
          {after_day0("c_custkey % 365")} AS created_on
        FROM customer""",
    "accounts": f"""
        SELECT c_custkey * 2 + 1 AS id, c_custkey + 1 AS user_id, 'Current' AS name,
          {money("c_acctbal")} AS opening_balance, {after_day0("c_custkey % 365")} AS created_on
        FROM customer
        UNION ALL
        SELECT c_custkey * 2 + 2, c_custkey + 1, 'Savings', {money("0")}, {after_day0("c_custkey % 365 + 30")}
        FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')""",
    "transactions": """
        SELECT o_orderkey + 1 AS id, o_custkey + 1 AS creator_id, o_orderpriority AS category,
          o_orderstatus = 'P' AS is_income, o_orderkey % 10 <> 0 AS include_in_reports,
          CASE WHEN o_orderkey % 4 <> 0 THEN concat('order ', CAST(o_orderkey AS VARCHAR)) END AS description,
          CASE WHEN o_orderstatus = 'O' THEN concat('for ', o_orderpriority) END AS notes,
          o_orderdate AS created_on
        FROM orders""",
    "slots": f"""
        SELECT l_orderkey, l_linenumber, {money("to_pay")} AS to_pay,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS slot,
          {money("sum(to_pay) OVER (PARTITION BY l_orderkey)")} AS total
        FROM (SELECT l_orderkey, l_linenumber, sum({money("l_extendedprice")}) AS to_pay
              FROM lineitem GROUP BY l_orderkey, l_linenumber) g""",
    "transaction_amounts": f"""
        SELECT s.l_orderkey * 10 + s.slot AS id, s.l_orderkey + 1 AS transaction_id,
          CASE WHEN s.slot = 1 AND o_orderkey % 13 = 0 THEN NULL WHEN s.slot = 5 THEN NULL
               ELSE ((o_custkey + (s.slot - 1) * 7) % {CUSTOMERS}) * 2 + 1 END AS account_id,
          CASE WHEN s.slot = 1 AND o_orderkey % 13 = 0 THEN 'Cash'
               WHEN s.slot = 5 THEN concat('Guest ', CAST(s.l_linenumber AS VARCHAR)) END AS account_name,
          s.to_pay AS amount_to_pay,
          {money('''CASE WHEN o_orderkey % 2 <> 0 THEN s.to_pay WHEN s.slot = 1 THEN s.total ELSE 0 END
            + CASE WHEN o_orderkey % 11 = 0 AND s.slot = 1 THEN 1 ELSE 0 END''')} AS amount_paid,
          o_orderdate AS created_on
        FROM slots s JOIN orders ON s.l_orderkey = o_orderkey""",
    "transaction_tags": """
        SELECT min(((l_orderkey * 8 + l_linenumber) * (SELECT max(p_partkey) + 1 FROM part) + l_partkey)
            * (SELECT max(len(string_split(p_name, ' '))) FROM part) + w) AS id,
          l_orderkey + 1 AS transaction_id, tag
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, w,
                CASE WHEN l_linenumber % 4 = 0 THEN concat(' ', upper(word)) ELSE word END AS tag
              FROM lineitem JOIN (
                SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
                  unnest(range(len(string_split(p_name, ' ')))) AS w FROM part) p ON l_partkey = p_partkey) t
        GROUP BY l_orderkey, tag""",
    "friends": f"""
        SELECT CASE WHEN u % 2 = 0 THEN u ELSE v END + 1 AS user_id,
          CASE WHEN u % 2 = 0 THEN v ELSE u END + 1 AS friend_id, {after_day0("u % 700")} AS created_on
        FROM (SELECT c_custkey AS u, (c_custkey + step) % {CUSTOMERS} AS v
              FROM customer, (VALUES (7), (14), (21)) AS steps(step)
              WHERE step = 7 OR (step = 14 AND c_mktsegment <> 'BUILDING') OR (step = 21 AND c_nationkey < 12)) e""",
    "friend_requests": f"""
        SELECT c_custkey + 1 AS user_id,
          (c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 7 ELSE 5 END) % {CUSTOMERS} + 1 AS friend_id,
          {after_day0("c_custkey % 500")} AS created_on
        FROM customer""",
    "friend_actions": """
        SELECT event_id AS seq, ts, user_id + 1 AS actor_id,
          abs(user_id + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 7 - 3) + 1 AS target_id,
          CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'request' WHEN 'click' THEN 'accept'
               WHEN 'view' THEN 'reject' ELSE 'remove' END AS action
        FROM events""",
    "amount_changes": f"""
        SELECT id * 4 + 1 AS change_id, created_on AS changed_on, 'I' AS op, transaction_id,
          CAST(NULL AS BIGINT) AS old_account_id, CAST(NULL AS {MONEY}) AS old_paid,
          account_id AS new_account_id, amount_paid AS new_paid
        FROM transaction_amounts
        UNION ALL
        SELECT id * 4 + 2, created_on + INTERVAL '1' DAY, 'U', transaction_id, account_id, amount_paid, account_id,
          {money("amount_paid + 10")}
        FROM transaction_amounts WHERE amount_paid < amount_to_pay
        UNION ALL
        SELECT id * 4 + 3, created_on + INTERVAL '2' DAY, 'D', transaction_id, account_id,
          {money("CASE WHEN amount_paid < amount_to_pay THEN amount_paid + 10 ELSE amount_paid END")}, NULL, NULL
        FROM transaction_amounts
        WHERE amount_paid > amount_to_pay OR (amount_paid < amount_to_pay AND amount_to_pay < 20000)""",
    "transaction_patches": """
        SELECT id AS transaction_id, creator_id AS user_id,
          CASE WHEN category = '3-MEDIUM' AND is_income THEN 'Adjusted' END AS category,
          CASE WHEN id % 17 = 0 THEN NOT is_income END AS is_income,
          CASE WHEN id % 51 = 0 THEN FALSE END AS include_in_reports,
          CASE WHEN id % 68 = 0 THEN '' END AS description,
          CASE WHEN category = '4-NOT SPECIFIED' THEN 'edited' END AS notes,
          category = '2-HIGH' OR (category = '1-URGENT' AND is_income) AS replace_amounts
        FROM transactions""",
    "amount_patches": f"""
        SELECT a.transaction_id, a.id % 10 AS position, a.id,
          CAST(NULL AS BIGINT) AS account_id, CAST(NULL AS VARCHAR) AS account_name,
          CASE WHEN a.id % 10 = 1 THEN {money("a.amount_to_pay + coalesce(b.amount_to_pay, 0)")} END AS amount_to_pay,
          CASE WHEN a.id % 10 = 1 THEN {money("a.amount_paid + coalesce(b.amount_paid, 0)")} END AS amount_paid
        FROM transaction_amounts a JOIN transactions t ON t.id = a.transaction_id
        LEFT JOIN transaction_amounts b ON b.transaction_id = a.transaction_id AND b.id % 10 = 2
        WHERE t.category = '2-HIGH' AND a.id % 10 <> 2
        UNION ALL
        SELECT id, 100, CASE WHEN kind = 0 THEN id * 10 + 1 END,
          CASE WHEN kind = -1 THEN (creator_id + 2) % {CUSTOMERS} * 2 + 1 WHEN kind = 1 THEN creator_id * 2 - 1
               WHEN kind = 2 THEN id + {CUSTOMERS} * 2 END,
          CASE WHEN is_income OR kind = 3 THEN 'Late guest' WHEN kind = 1 THEN 'Twice' END,
          {money("0")}, CASE WHEN kind <> 3 THEN {money("0")} END
        FROM (SELECT *, CASE WHEN is_income THEN -2 WHEN notes IS NOT NULL THEN -1 ELSE id % 4 END AS kind
              FROM transactions WHERE category = '2-HIGH') h""",
    "tag_additions": """
        SELECT a.id * 2 AS seq, creator_id AS user_id, transaction_id,
          CASE a.id % 10 WHEN 1 THEN category WHEN 2 THEN chr(9) || lower(category) || ' ' WHEN 5 THEN ''
               ELSE 'slot ' || CAST(a.id % 10 AS VARCHAR) END AS tag
        FROM transaction_amounts a JOIN transactions t ON t.id = a.transaction_id
        UNION ALL
        SELECT g.id * 2 + 1, creator_id, transaction_id, upper(tag) || ' '
        FROM transaction_tags g JOIN transactions t ON t.id = g.transaction_id""",
    "tag_removals": """
        SELECT g.id AS seq, creator_id AS user_id, t.id AS transaction_id, g.id AS tag_id
        FROM (SELECT id, transaction_id + CASE WHEN tag = upper(tag) THEN 0 ELSE 1 END AS asked FROM transaction_tags) g
        JOIN transactions t ON t.id = g.asked""",
    "account_requests": f"""
        SELECT o_orderkey + 1 AS seq, o_orderdate AS opened_on,
          CASE WHEN o_totalprice > 450000 THEN 0 WHEN o_totalprice < 20000 THEN o_custkey + 1 + {CUSTOMERS}
               ELSE o_custkey + 1 END AS user_id,
          CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS name,
          CASE o_orderstatus WHEN 'F' THEN {money("o_totalprice")} WHEN 'P' THEN -{money("o_totalprice")} END
            AS initial_balance
        FROM orders""",
    "account_renames": """
        SELECT a.id AS seq, creator_id AS user_id, account_id,
          CASE WHEN category = '5-LOW' THEN '' ELSE concat('Purse ', category) END AS name
        FROM transaction_amounts a JOIN transactions t ON t.id = a.transaction_id WHERE account_id IS NOT NULL""",
    "account_closures": """
        SELECT c_custkey * 2 + k AS seq, c_custkey + 1 + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS user_id,
          c_custkey * 2 + 1 AS account_id
        FROM customer, (VALUES (0), (1)) AS twice(k)""",
    "new_friend_requests": f"""
        SELECT o_orderkey + 1 AS seq, o_custkey + 1 AS user_id,
          CASE WHEN o_totalprice < 50000 THEN concat('nobody_', username) WHEN o_orderstatus = 'P' THEN email
               WHEN o_orderstatus = 'F' THEN upper(username) ELSE username END AS identifier
        FROM orders JOIN users ON id = (o_custkey + o_orderkey % 16) % {CUSTOMERS} + 1""",
    "friend_responses": f"""
        SELECT user_id * 4 + k AS seq, created_on + INTERVAL '3' DAY AS responded_on, friend_id AS user_id,
          user_id AS friend_id,
          CASE WHEN day(created_on) <= 20 THEN 'accept' WHEN day(created_on) <= 27 THEN 'reject' ELSE 'later' END AS action
        FROM friend_requests, (VALUES (0), (1)) AS twice(k)
        UNION ALL
        SELECT (user_id * ({CUSTOMERS} + 1) + friend_id) * 4 + 2, min(created_on), user_id, friend_id, 'accept'
        FROM friends GROUP BY user_id, friend_id""",
    "friend_removals": """
        SELECT user_id * 2 AS seq, user_id, friend_id FROM friend_requests
        UNION ALL SELECT user_id * 2 + 1, friend_id, user_id FROM friend_requests""",
    "leaving_users": "SELECT c_custkey + 1 AS user_id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "new_users": """
        SELECT o_orderkey + 1 AS seq,
          CASE o_orderpriority WHEN '1-URGENT' THEN concat('New_User_', o_custkey)
            WHEN '2-HIGH' THEN concat('CUSTOMER_', lpad(CAST(o_custkey AS VARCHAR), 9, '0'))
            WHEN '3-MEDIUM' THEN 'ab' WHEN '4-NOT SPECIFIED' THEN concat('user ', o_custkey)
            ELSE concat('other_', o_custkey) END AS username,
          concat('u', o_custkey, CASE WHEN o_orderstatus = 'O' THEN '..x@example.com'
            WHEN o_orderpriority = '5-LOW' THEN '+low@mail.example.org' ELSE '@mail.example.org' END) AS email
        FROM orders""",
    "session_claims": f"""
        SELECT event_id AS session_id, user_id + 1 + CASE WHEN value > 55 THEN {CUSTOMERS} ELSE 0 END AS user_id,
          CASE WHEN value >= 0.5 THEN concat('customer_', user_id) ELSE '' END AS user_name,
          CASE WHEN event_type <> 'error' OR value >= 1 THEN concat('customer_', user_id, '@example.com') END AS email,
          ts AS issued_at, ts + INTERVAL '1' DAY * CAST(event_id % 30 AS INT) AS expires_at,
          event_type = 'signup' AS refresh
        FROM events""",
    "user_modified": """
        SELECT user_id + 1 AS user_id, max(ts) AS modified_on FROM events
        WHERE event_type = 'error' AND value > 20 GROUP BY user_id""",
    # The create requests, before they were made JSON; some bodies are replaced by faulty ones.
    "request_bodies": f"""
        SELECT *, CASE WHEN l_orderkey % {FAULTY_EVERY} < {len(FAULTY_BODIES)} THEN l_orderkey % {FAULTY_EVERY} END AS faulty
        FROM slots JOIN orders ON l_orderkey = o_orderkey""",
    "request_headers": f"""
        SELECT l_orderkey * 10 + slot AS id, o_custkey + 1 AS creator_id,
          CASE WHEN faulty IN ({_KINDS}) THEN 'c' WHEN faulty IS NOT NULL THEN NULL
               WHEN slot = 7 AND o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS category,
          faulty IS NULL AND o_orderstatus = 'P' AS is_income, faulty IS NOT NULL OR slot <> 2 AS include_in_reports,
          CASE WHEN faulty IS NULL AND slot <> 3 THEN concat('line ', CAST(l_linenumber AS VARCHAR)) END AS description,
          CASE WHEN faulty IS NULL AND slot = 2 THEN 'shared' END AS notes, o_orderdate AS created_on,
          CASE WHEN faulty IS NOT NULL THEN CASE faulty {_SHAPES} END
               WHEN slot = 7 AND o_orderstatus = 'F' THEN 'no_category' WHEN slot = 7 THEN 'empty'
               WHEN to_pay < 1 OR (slot = 6 AND o_orderstatus = 'P') THEN 'negative' END AS shape
        FROM request_bodies""",
    "request_amounts": f"""
        SELECT l_orderkey * 10 + s.slot AS transaction_id, o_custkey + 1 AS creator_id, CAST(1 AS BIGINT) AS slot,
          CASE WHEN s.slot <> 6 THEN o_custkey * 2 + 1 END AS account_id,
          CASE WHEN s.slot = 6 THEN 'Cash' WHEN s.slot = 1 AND o_orderstatus = 'F' THEN 'Mine' END AS account_name,
          {money("to_pay - 1")} AS amount_to_pay,
          {money("to_pay + CASE WHEN s.slot = 5 AND o_orderstatus = 'P' THEN 5 ELSE 0 END")} AS amount_paid,
          o_orderdate AS created_on
        FROM request_bodies s WHERE s.slot <> 7 AND faulty IS NULL
        UNION ALL
        SELECT l_orderkey * 10 + slot, o_custkey + 1, 1,
          CASE account WHEN 'own' THEN o_custkey * 2 + 1 WHEN 'stranger' THEN (o_custkey + 3) % {CUSTOMERS} * 2 + 1 END,
          name, {money("share")}, {money("payment")}, o_orderdate
        FROM request_bodies JOIN (VALUES {_READABLE}) AS readable(kind, account, name, share, payment) ON kind = faulty
        UNION ALL
        SELECT l_orderkey * 10 + s.slot, o_custkey + 1, 2,
          CASE s.slot WHEN 2 THEN (o_custkey + 7) % {CUSTOMERS} * 2 + 1 WHEN 3 THEN (o_custkey + 3) % {CUSTOMERS} * 2 + 1
            WHEN 4 THEN o_custkey * 2 + 1 + {CUSTOMERS} * 2 END,
          CASE WHEN s.slot IN (1, 6) OR (s.slot = 5 AND o_orderstatus <> 'O') THEN 'Guest' END,
          {money("CASE WHEN s.slot = 6 AND o_orderstatus = 'P' THEN -1 ELSE 1 END")}, {money("0")}, o_orderdate
        FROM request_bodies s WHERE s.slot <> 7 AND faulty IS NULL""",
    # Shared steps of the checks.
    "edges": """
        SELECT DISTINCT least(user_id, friend_id) AS lo, greatest(user_id, friend_id) AS hi FROM friends""",
    "mutual": """
        SELECT user_id, friend_id, min(created_on) AS created_on
        FROM (SELECT user_id, friend_id, created_on FROM friends
              UNION ALL SELECT friend_id, user_id, created_on FROM friends) b
        GROUP BY user_id, friend_id""",
    "visible": """
        SELECT DISTINCT user_id, transaction_id FROM transaction_amounts JOIN accounts ON accounts.id = account_id""",
    "balances": f"""
        SELECT a.id AS account_id, a.user_id, CAST(a.opening_balance + coalesce(m.moved, 0) AS {TOTAL}) AS balance
        FROM accounts a LEFT JOIN (
          SELECT account_id, sum(CASE WHEN is_income THEN amount_paid ELSE -amount_paid END) AS moved
          FROM transaction_amounts JOIN transactions t ON t.id = transaction_id
          WHERE account_id IS NOT NULL GROUP BY account_id) m ON m.account_id = a.id""",
    "patched_transactions": """
        SELECT t.id, creator_id, coalesce(nullif(p.category, ''), t.category) AS category,
          coalesce(p.is_income, t.is_income) AS is_income,
          coalesce(p.include_in_reports, t.include_in_reports) AS include_in_reports,
          coalesce(nullif(p.description, ''), t.description) AS description,
          coalesce(nullif(p.notes, ''), t.notes) AS notes, created_on
        FROM transactions t LEFT JOIN transaction_patches p ON p.transaction_id = t.id""",
    "patched_amounts": f"""
        SELECT a.id, a.transaction_id, a.account_id, a.account_name,
          coalesce(p.amount_to_pay, a.amount_to_pay) AS amount_to_pay,
          coalesce(p.amount_paid, a.amount_paid) AS amount_paid, a.created_on
        FROM transaction_amounts a JOIN transaction_patches t ON t.transaction_id = a.transaction_id
        LEFT JOIN amount_patches p ON p.id = a.id AND p.transaction_id = a.transaction_id
        WHERE NOT t.replace_amounts OR p.id IS NOT NULL
        UNION ALL
        SELECT NULL, p.transaction_id, p.account_id, p.account_name, p.amount_to_pay, p.amount_paid, NULL
        FROM amount_patches p JOIN transaction_patches t ON t.transaction_id = p.transaction_id
        WHERE p.id IS NULL AND t.replace_amounts""",
    "after_edit": """
        SELECT transaction_id,
          CASE WHEN bool_or((account_id IS NULL) = (account_name IS NULL)) THEN 'either_or'
            WHEN count(*) > count(DISTINCT concat(account_id, '|', account_name)) THEN 'repeated'
            WHEN abs(sum(amount_paid) - sum(amount_to_pay)) >= 0.01 THEN 'unbalanced'
            WHEN count(account_id) = 0 THEN 'no_account' ELSE 'ok' END AS verdict
        FROM patched_amounts JOIN transaction_patches p USING (transaction_id)
        WHERE p.replace_amounts GROUP BY transaction_id""",
    "rejected_patches": """
        SELECT p.transaction_id, p.position, p.id,
          CASE WHEN p.account_id <= 0 THEN 'bad_account_id' WHEN p.account_name = '' THEN 'empty_name'
            WHEN p.amount_to_pay < 0 OR p.amount_paid < 0 THEN 'negative'
            WHEN p.id IS NOT NULL AND s.id IS NULL THEN 'foreign_id'
            WHEN p.id IS NULL AND p.account_id IS NULL AND p.account_name IS NULL THEN 'neither'
            WHEN p.account_id IS NOT NULL AND p.account_name IS NOT NULL THEN 'both'
            WHEN p.account_id IS NOT NULL AND a.id IS NULL THEN 'unknown_account'
            WHEN p.account_id IS NOT NULL AND a.user_id <> t.user_id AND e.lo IS NULL THEN 'no_access'
            WHEN p.id IS NULL AND p.amount_paid IS NULL THEN 'no_amount_paid'
            WHEN p.id IS NULL AND p.amount_to_pay IS NULL THEN 'no_amount_to_pay' END AS reason
        FROM amount_patches p JOIN transaction_patches t ON t.transaction_id = p.transaction_id AND t.replace_amounts
        LEFT JOIN transaction_amounts s ON s.id = p.id AND s.transaction_id = p.transaction_id
        LEFT JOIN accounts a ON a.id = p.account_id
        LEFT JOIN edges e ON e.lo = least(t.user_id, a.user_id) AND e.hi = greatest(t.user_id, a.user_id)""",
    "edits_judged": """
        SELECT p.transaction_id,
          CASE WHEN p.category = '' OR p.description = '' OR p.notes = '' THEN 'empty_field'
            WHEN v.user_id IS NULL THEN 'not_found' WHEN r.reason IS NOT NULL THEN r.reason
            WHEN p.replace_amounts AND e.verdict IS NULL AND (p.category IS NOT NULL OR p.is_income IS NOT NULL
              OR p.include_in_reports IS NOT NULL OR p.description IS NOT NULL OR p.notes IS NOT NULL)
              THEN 'delete_with_updates'
            WHEN p.replace_amounts AND e.verdict IS NULL THEN 'deleted'
            ELSE coalesce(e.verdict, 'ok') END AS verdict
        FROM transaction_patches p
        LEFT JOIN visible v ON v.user_id = p.user_id AND v.transaction_id = p.transaction_id
        LEFT JOIN (SELECT transaction_id, arg_min(reason, position) AS reason FROM rejected_patches
                   WHERE reason IS NOT NULL GROUP BY transaction_id) r ON r.transaction_id = p.transaction_id
        LEFT JOIN after_edit e ON e.transaction_id = p.transaction_id""",
    "first_step": """
        SELECT a.transaction_id, a.id, account_id, account_name, amount_to_pay, amount_paid FROM patched_amounts a
        JOIN edits_judged j ON j.transaction_id = a.transaction_id WHERE verdict = 'ok'
        UNION ALL
        SELECT a.transaction_id, a.id, account_id, account_name, amount_to_pay, amount_paid FROM transaction_amounts a
        JOIN edits_judged j ON j.transaction_id = a.transaction_id WHERE verdict NOT IN ('ok', 'deleted')""",
    "third_step": """
        SELECT t.id AS transaction_id, category = '2-HIGH' AS high, s.n_amounts, s.paid, f.amount_paid AS own,
          coalesce(s.seen, FALSE) AS seen,
          CASE WHEN NOT coalesce(s.seen, FALSE) THEN 'not_found' WHEN f.id IS NULL THEN 'foreign_id'
            WHEN (f.account_id IS NULL) = (f.account_name IS NULL) THEN 'either_or'
            WHEN abs(f.amount_paid - f.amount_to_pay) >= 0.01 THEN 'unbalanced'
            WHEN f.account_id IS NULL THEN 'no_account' ELSE 'ok' END AS verdict
        FROM transactions t
        LEFT JOIN (SELECT transaction_id, count(*) AS n_amounts, sum(amount_paid) AS paid, bool_or(a.user_id = p.user_id) AS seen
                   FROM first_step JOIN transaction_patches p USING (transaction_id)
                   LEFT JOIN accounts a ON a.id = account_id GROUP BY transaction_id) s ON s.transaction_id = t.id
        LEFT JOIN first_step f ON f.transaction_id = t.id AND f.id = t.id * 10 - 9""",
    "edit_steps": """
        SELECT t.transaction_id, 1 AS step, j.verdict, t.n_amounts, t.paid FROM third_step t JOIN edits_judged j USING (transaction_id)
        UNION ALL
        SELECT transaction_id, 2, CASE WHEN NOT seen THEN 'not_found' WHEN high THEN 'unbalanced' ELSE 'ok' END, n_amounts, paid
        FROM third_step
        UNION ALL
        SELECT transaction_id, 3, verdict, CASE WHEN verdict = 'ok' THEN 1 ELSE n_amounts END,
          CASE WHEN verdict = 'ok' THEN own ELSE paid END FROM third_step""",
    "edited_amounts": """
        SELECT a.transaction_id, account_id, amount_paid FROM patched_amounts a
        JOIN edits_judged j ON j.transaction_id = a.transaction_id WHERE verdict = 'ok'
        UNION ALL
        SELECT a.transaction_id, account_id, amount_paid FROM transaction_amounts a
        JOIN edits_judged j ON j.transaction_id = a.transaction_id WHERE verdict NOT IN ('ok', 'deleted')""",
    "edited_effects": """
        SELECT account_id, sum(CASE WHEN CASE WHEN verdict = 'ok' THEN n.is_income ELSE o.is_income END
            THEN amount_paid ELSE -amount_paid END) AS moved
        FROM edited_amounts a JOIN edits_judged j ON j.transaction_id = a.transaction_id
        JOIN transactions o ON o.id = a.transaction_id JOIN patched_transactions n ON n.id = a.transaction_id
        WHERE account_id IS NOT NULL GROUP BY account_id""",
    "tagged": """
        SELECT transaction_id FROM transaction_tags WHERE tag IN ('red', 'ring')
        GROUP BY transaction_id HAVING count(DISTINCT tag) = 2""",
    "found": """
        SELECT v.user_id, t.id, t.created_on FROM visible v JOIN transactions t ON t.id = v.transaction_id
        WHERE t.id IN (SELECT transaction_id FROM tagged)""",
    "additions_judged": f"""
        SELECT n.seq, n.user_id, n.transaction_id, n.tag,
          CASE WHEN n.tag = '' THEN 'empty' WHEN v.user_id IS NULL THEN 'not_found' WHEN e.same IS NOT NULL THEN 'exists'
            WHEN row_number() OVER (PARTITION BY n.transaction_id, {same_tag("n.tag")},
                 n.tag <> '' AND v.user_id IS NOT NULL AND e.same IS NULL ORDER BY n.seq) = 1 THEN 'accepted'
            ELSE 'exists' END AS verdict
        FROM tag_additions n
        LEFT JOIN visible v ON v.user_id = n.user_id AND v.transaction_id = n.transaction_id
        LEFT JOIN (SELECT DISTINCT transaction_id, {same_tag("tag")} AS same FROM transaction_tags) e
          ON e.transaction_id = n.transaction_id AND e.same = {same_tag("n.tag")}""",
    "removals_judged": """
        SELECT r.seq, r.user_id, r.transaction_id, r.tag_id,
          CASE WHEN v.user_id IS NULL THEN 'not_found' WHEN g.id IS NULL THEN 'no_such_tag' ELSE 'removed' END AS verdict
        FROM tag_removals r
        LEFT JOIN visible v ON v.user_id = r.user_id AND v.transaction_id = r.transaction_id
        LEFT JOIN transaction_tags g ON g.id = r.tag_id AND g.transaction_id = r.transaction_id""",
    "identified": """
        SELECT r.seq, r.user_id, r.identifier, coalesce(n.id, e.id) AS friend_id
        FROM new_friend_requests r
        LEFT JOIN users n ON n.username = lower(r.identifier) LEFT JOIN users e ON e.email = r.identifier""",
    "responses_judged": """
        SELECT seq, responded_on, user_id, friend_id,
          CASE WHEN refusal IS NOT NULL THEN refusal
            WHEN row_number() OVER (PARTITION BY user_id, friend_id, refusal IS NULL ORDER BY seq) > 1 THEN 'not_found'
            WHEN action = 'accept' THEN 'accepted' ELSE 'rejected' END AS verdict
        FROM (SELECT a.seq, a.responded_on, a.user_id, a.friend_id, a.action,
                CASE WHEN a.action NOT IN ('accept', 'reject') THEN 'bad_action' WHEN r.user_id IS NULL THEN 'not_found'
                     WHEN a.action = 'accept' AND f.user_id IS NOT NULL THEN 'already_friends' END AS refusal
              FROM friend_responses a
              LEFT JOIN friend_requests r ON r.user_id = a.friend_id AND r.friend_id = a.user_id
              LEFT JOIN (SELECT DISTINCT user_id, friend_id FROM friends) f
                ON f.user_id = a.user_id AND f.friend_id = a.friend_id) x""",
    "views_of_friends": """
        SELECT DISTINCT user_id AS viewer_id, friend_id
        FROM (SELECT user_id, friend_id FROM friend_requests UNION ALL SELECT user_id, friend_id FROM friends) u""",
    "openings_judged": """
        SELECT seq, opened_on, r.user_id, name, initial_balance,
          CASE WHEN r.user_id <= 0 THEN 'bad_user_id' WHEN name = '' THEN 'empty_name'
            WHEN u.id IS NULL THEN 'unknown_user' ELSE 'opened' END AS verdict
        FROM account_requests r LEFT JOIN users u ON u.id = r.user_id""",
    "renames_judged": """
        SELECT seq, r.user_id, account_id, r.name,
          CASE WHEN r.name = '' THEN 'empty_name' WHEN a.id IS NULL THEN 'not_found' ELSE 'renamed' END AS verdict
        FROM account_renames r LEFT JOIN accounts a ON a.id = r.account_id AND a.user_id = r.user_id""",
    "closures_judged": """
        SELECT seq, c.user_id, account_id,
          CASE WHEN a.id IS NOT NULL AND row_number() OVER (PARTITION BY account_id, a.id IS NOT NULL ORDER BY seq) = 1
            THEN 'deleted' ELSE 'not_found' END AS verdict
        FROM account_closures c LEFT JOIN accounts a ON a.id = c.account_id AND a.user_id = c.user_id""",
    "reported": """
        SELECT t.id AS transaction_id, a.user_id, date_trunc('month', t.created_on) AS month, category, is_income,
          amount_paid
        FROM transactions t JOIN transaction_amounts m ON m.transaction_id = t.id JOIN accounts a ON a.id = m.account_id
        WHERE include_in_reports""",
}


def _split_rows(amounts: str, creators: str, order: str) -> str:
    """Amount rows of `amounts` with what the owner is to the creator."""
    return f"""
        SELECT m.transaction_id, m.{order} AS place, m.account_id, m.account_name, m.amount_to_pay, m.amount_paid,
          a.user_id = c.creator_id AS own, e.lo IS NOT NULL AS friend, a.id IS NOT NULL AS known
        FROM {amounts} m JOIN {creators} c ON c.id = m.transaction_id
        LEFT JOIN accounts a ON a.id = m.account_id
        LEFT JOIN edges e ON e.lo = least(a.user_id, c.creator_id) AND e.hi = greatest(a.user_id, c.creator_id)"""


def _split_verdicts(amounts: str, creators: str, order: str) -> str:
    reason = """CASE WHEN account_id IS NULL AND coalesce(account_name, '') = '' THEN 'neither'
          WHEN account_id IS NOT NULL AND coalesce(account_name, '') <> '' THEN 'both'
          WHEN account_id IS NOT NULL AND NOT known THEN 'unknown_account'
          WHEN account_id IS NOT NULL AND NOT own AND NOT friend THEN 'no_access' END"""
    return f"""
        SELECT c.id AS transaction_id,
          CASE WHEN g.transaction_id IS NULL THEN 'empty' WHEN negative THEN 'negative'
            WHEN first_reason IS NOT NULL THEN first_reason WHEN gap THEN 'unbalanced' WHEN NOT own THEN 'no_self'
            ELSE 'ok' END AS verdict,
          concat_ws(',', CASE WHEN g.transaction_id IS NULL THEN 'empty' END, CASE WHEN negative THEN 'negative' END,
            CASE WHEN neither THEN 'neither' END, CASE WHEN both_given THEN 'both' END,
            CASE WHEN unknown THEN 'unknown_account' END, CASE WHEN no_access THEN 'no_access' END,
            CASE WHEN gap THEN 'unbalanced' END, CASE WHEN NOT own THEN 'no_self' END) AS reasons
        FROM {creators} c LEFT JOIN (
          SELECT transaction_id, bool_or(amount_to_pay < 0 OR amount_paid < 0) AS negative,
            arg_min(reason, place) FILTER (WHERE reason IS NOT NULL) AS first_reason,
            bool_or(coalesce(reason = 'neither', FALSE)) AS neither, bool_or(coalesce(reason = 'both', FALSE)) AS both_given,
            bool_or(coalesce(reason = 'unknown_account', FALSE)) AS unknown,
            bool_or(coalesce(reason = 'no_access', FALSE)) AS no_access,
            abs(sum(amount_paid) - sum(amount_to_pay)) >= 0.01 AS gap, bool_or(coalesce(own, FALSE)) AS own
          FROM (SELECT *, {reason} AS reason FROM ({_split_rows(amounts, creators, order)}) r) q
          GROUP BY transaction_id) g ON g.transaction_id = c.id"""


VIEWS["request_splits"] = _split_verdicts("request_amounts", "request_headers", "slot")
VIEWS["split_rows"] = _split_rows("transaction_amounts", "transactions", "id")

VIEWS["filters_read"] = f"""
        SELECT seq, coalesce(page_n, 1) AS page_no, coalesce(limit_n, 20) AS page_limit, start_on, end_on,
          nullif(category, '') AS category, account_n AS account_id, coalesce(array_to_string(tags, ','), '') AS tags, tags AS wanted_tags,
          CASE WHEN page <> '' AND page_n IS NULL THEN 'page:no_number' WHEN page_n <= 0 THEN 'page:not_positive'
            WHEN page_limit IS NOT NULL AND limit_n IS NULL THEN 'limit:no_number'
            WHEN start_on IS NULL THEN 'start_date:no_date' WHEN list_contains(tags, '') THEN 'tags:empty_tag'
            WHEN account_n IS NULL THEN 'account_id:no_number' END AS reason
        FROM (SELECT *, {_whole("page")} AS page_n, {_whole("page_limit")} AS limit_n, {_whole("account")} AS account_n,
                CASE WHEN seq % 13 = 1 THEN TIMESTAMP '1997-02-03 02:05:06' ELSE TRY_CAST(start_date AS TIMESTAMP) END AS start_on,
                CASE WHEN seq % 3 = 0 THEN CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' AS TIMESTAMP) + INTERVAL '330' MINUTE END AS end_on
              FROM (SELECT o_orderkey AS seq, o_orderdate,
                      CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-3' WHEN 4 THEN ' 12abc'
                           ELSE CAST(o_orderkey % 50 + 1 AS VARCHAR) END AS page,
                      CASE o_orderkey % 7 WHEN 0 THEN '5.9' WHEN 1 THEN 'many' END AS page_limit,
                      CASE o_orderkey % 13 WHEN 0 THEN '1997-13-01' WHEN 1 THEN '1997-02-03T04:05:06+02:00' WHEN 2 THEN 'yesterday'
                           WHEN 3 THEN '1996-01-01T00:00:00.500Z' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_date,
                      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS category,
                      CASE o_orderkey % 17 WHEN 0 THEN '1e3' WHEN 1 THEN 'x7' ELSE CAST(o_custkey * 2 + 1 AS VARCHAR) END AS account,
                      CASE WHEN o_orderkey % 19 = 0 THEN ['red', ''] WHEN o_orderkey % 19 > 13 THEN ['red', o_orderstatus]
                           WHEN o_orderkey % 19 > 9 THEN ['red'] END AS tags
                    FROM orders) t) n"""
VIEWS["searched"] = """
        SELECT DISTINCT f.seq, t.id, t.created_on
        FROM filters_read f JOIN orders ON o_orderkey = f.seq
        JOIN accounts a ON a.user_id = o_custkey + 1 AND (f.account_id IS NULL OR f.account_id = a.id)
        JOIN transaction_amounts m ON m.account_id = a.id JOIN transactions t ON t.id = m.transaction_id
        WHERE f.reason IS NULL AND (f.start_on IS NULL OR t.created_on >= f.start_on)
          AND (f.end_on IS NULL OR t.created_on <= f.end_on) AND (f.category IS NULL OR f.category = t.category)
          AND (f.wanted_tags IS NULL OR len(list_distinct(f.wanted_tags)) = (
            SELECT count(DISTINCT tag) FROM transaction_tags g
            WHERE g.transaction_id = t.id AND list_contains(f.wanted_tags, g.tag)))"""

_DELTAS = f"""
        SELECT account_id, {total("delta")} AS delta
        FROM (SELECT old_account_id AS account_id, CASE WHEN is_income THEN -old_paid ELSE old_paid END AS delta
              FROM amount_changes JOIN transactions t ON t.id = transaction_id
              UNION ALL
              SELECT new_account_id, CASE WHEN is_income THEN new_paid ELSE -new_paid END
              FROM amount_changes JOIN transactions t ON t.id = transaction_id) d
        WHERE account_id IS NOT NULL GROUP BY account_id"""

_TURNED = f"""
        SELECT account_id, {total("CASE WHEN n.is_income THEN 2 * amount_paid ELSE -2 * amount_paid END")} AS delta
        FROM transactions o JOIN patched_transactions n ON n.id = o.id AND n.is_income <> o.is_income
        JOIN transaction_amounts ON transaction_id = o.id WHERE account_id IS NOT NULL GROUP BY account_id"""

_REQUEST_VERDICTS = """
        SELECT h.id AS transaction_id, coalesce(shape, verdict) AS verdict
        FROM request_headers h JOIN request_splits s ON s.transaction_id = h.id"""

_REPLAY = """
        SELECT lo, hi, arg_max(state, n) AS state
        FROM played WHERE n > 0 GROUP BY lo, hi"""

VIEWS["acts"] = """
        SELECT lo, hi, actor_id = lo AS by_low, action, row_number() OVER (PARTITION BY lo, hi ORDER BY ts, seq) AS n
        FROM (SELECT *, least(actor_id, target_id) AS lo, greatest(actor_id, target_id) AS hi FROM friend_actions) a
        WHERE lo <> hi"""
VIEWS["played"] = """
        SELECT DISTINCT lo, hi, CAST(0 AS BIGINT) AS n, 0 AS state FROM acts
        UNION ALL
        SELECT a.lo, a.hi, a.n,
          CASE WHEN p.state = 0 AND action = 'request' THEN CASE WHEN by_low THEN 1 ELSE 2 END
            WHEN p.state = 1 AND NOT by_low AND action = 'accept' THEN 3
            WHEN p.state = 2 AND by_low AND action = 'accept' THEN 3
            WHEN p.state = 1 AND NOT by_low AND action = 'reject' THEN 0
            WHEN p.state = 2 AND by_low AND action = 'reject' THEN 0
            WHEN p.state = 3 AND action = 'remove' THEN 0 ELSE p.state END
        FROM played p JOIN acts a ON a.lo = p.lo AND a.hi = p.hi AND a.n = p.n + 1"""


def _audit(refresh: str) -> str:
    now = "(SELECT max(ts) FROM events)"
    return f"""
        SELECT session_id, c.user_id,
          CASE WHEN expires_at IS NULL THEN 'no_expiry' WHEN issued_at IS NULL THEN 'no_issue_time'
            WHEN date_trunc('second', expires_at) < date_trunc('second', {now}) THEN 'expired'
            WHEN date_trunc('second', issued_at) > date_trunc('second', {now}) THEN 'not_yet_valid'
            WHEN c.user_id <= 0 OR user_name = '' OR c.email IS NULL THEN 'missing_claims' {refresh}
            WHEN u.id IS NULL THEN 'unknown_user'
            WHEN date_trunc('second', modified_on) > date_trunc('second', issued_at) THEN 'user_changed'
            ELSE 'valid' END AS verdict
        FROM session_claims c LEFT JOIN users u ON u.id = c.user_id LEFT JOIN user_modified m ON m.user_id = c.user_id"""


def _straggles(key: str, time: str, table: str, days: int) -> str:
    return f"{key} % 53 = 0 AND {time} < (SELECT max({time}) FROM {table}) - INTERVAL '{days}' DAY"


_ACCOUNT_COLUMNS = "id, user_id, name, opening_balance, created_on"

CHECKS = {
    "account_balances": "SELECT * FROM balances",
    "balance_delta_from_changes": _DELTAS,
    "balance_delta_from_direction_change": _TURNED,
    "refresh_balances": f"""
        SELECT b.account_id, b.user_id, CAST(balance + coalesce(delta, 0) AS {TOTAL}) AS balance
        FROM balances b LEFT JOIN (
          SELECT account_id, sum(CASE WHEN is_income THEN delta ELSE -delta END) AS delta
          FROM (SELECT transaction_id, old_account_id AS account_id, -old_paid AS delta FROM amount_changes WHERE op <> 'I'
                UNION ALL SELECT transaction_id, new_account_id, new_paid FROM amount_changes WHERE op <> 'I') c
          JOIN transactions t ON t.id = transaction_id WHERE account_id IS NOT NULL GROUP BY account_id) d
          ON d.account_id = b.account_id""",
    "total_balance": f"SELECT user_id, {total('balance')} AS total FROM balances GROUP BY user_id",
    "accounts_by_user": f"""
        SELECT {_ACCOUNT_COLUMNS}, row_number() OVER (PARTITION BY user_id ORDER BY created_on DESC, id DESC) AS position
        FROM accounts""",
    "accounts_of_one": f"SELECT {_ACCOUNT_COLUMNS} FROM accounts WHERE user_id = 8",
    "visible_accounts": """
        SELECT v.viewer_id, a.id AS account_id, a.user_id AS owner_id, a.name,
          CASE WHEN a.user_id = viewer_id THEN balance END AS balance,
          CASE WHEN a.user_id = viewer_id THEN created_on END AS created_on, a.user_id <> viewer_id AS is_masked
        FROM (SELECT DISTINCT creator_id AS viewer_id, account_id
              FROM transaction_amounts JOIN transactions t ON t.id = transaction_id WHERE account_id IS NOT NULL) v
        JOIN accounts a ON a.id = v.account_id JOIN balances b ON b.account_id = a.id
        LEFT JOIN edges e ON e.lo = least(viewer_id, a.user_id) AND e.hi = greatest(viewer_id, a.user_id)
        WHERE a.user_id = viewer_id OR e.lo IS NOT NULL""",
    "friend_accounts": """
        SELECT v.viewer_id, v.friend_id, username, a.id AS account_id, a.name, a.created_on,
          row_number() OVER (PARTITION BY v.viewer_id, v.friend_id ORDER BY a.created_on DESC, a.id DESC) AS position
        FROM views_of_friends v JOIN edges e ON e.lo = least(viewer_id, friend_id) AND e.hi = greatest(viewer_id, friend_id)
        JOIN users u ON u.id = v.friend_id JOIN accounts a ON a.user_id = v.friend_id""",
    "friend_accounts_verdicts": """
        SELECT v.viewer_id, v.friend_id, username, CASE WHEN e.lo IS NULL THEN 'not_friends' ELSE 'ok' END AS verdict
        FROM views_of_friends v
        LEFT JOIN edges e ON e.lo = least(viewer_id, friend_id) AND e.hi = greatest(viewer_id, friend_id)
        LEFT JOIN users u ON u.id = v.friend_id""",
    "open_accounts": f"""
        SELECT {_ACCOUNT_COLUMNS} FROM accounts
        UNION ALL
        SELECT (SELECT max(id) FROM accounts) + seq, user_id, name, {money("coalesce(initial_balance, 0)")}, opened_on
        FROM openings_judged WHERE verdict = 'opened'""",
    "open_accounts_verdicts": "SELECT seq, user_id, name, verdict FROM openings_judged",
    "rename_accounts": """
        SELECT a.id, a.user_id, coalesce(r.name, a.name) AS name, opening_balance, created_on
        FROM accounts a LEFT JOIN (SELECT account_id, arg_max(name, seq) AS name FROM renames_judged
          WHERE verdict = 'renamed' GROUP BY account_id) r ON r.account_id = a.id""",
    "rename_accounts_verdicts": "SELECT seq, user_id, account_id, name, verdict FROM renames_judged",
    "delete_accounts": """
        SELECT m.id, transaction_id, CASE WHEN c.account_id IS NULL THEN m.account_id END AS account_id,
          CASE WHEN c.account_id IS NULL THEN account_name ELSE a.name END AS account_name,
          amount_to_pay, amount_paid, m.created_on
        FROM transaction_amounts m
        LEFT JOIN closures_judged c ON c.account_id = m.account_id AND c.verdict = 'deleted'
        LEFT JOIN accounts a ON a.id = m.account_id""",
    "delete_accounts_remaining": f"""
        SELECT {_ACCOUNT_COLUMNS} FROM accounts
        WHERE id NOT IN (SELECT account_id FROM closures_judged WHERE verdict = 'deleted')""",
    "delete_accounts_verdicts": "SELECT seq, user_id, account_id, verdict FROM closures_judged",
    "account_by_id": """
        SELECT i.account_id, user_id, name, a.id IS NOT NULL AS found
        FROM (SELECT o_orderkey * 2 + 1 AS account_id FROM orders UNION SELECT o_custkey * 2 + 2 FROM orders) i
        LEFT JOIN accounts a ON a.id = i.account_id""",
    "flatten_requests": "SELECT * FROM request_headers",
    "requests_from_json": "SELECT * FROM request_headers",
    "flatten_requests_amounts": "SELECT * FROM request_amounts",
    "flatten_requests_tags": """
        SELECT id AS transaction_id, CAST(k AS BIGINT) AS slot,
          CASE k WHEN 1 THEN 'bill' WHEN 2 THEN ' Bill' ELSE o_orderstatus END AS tag
        FROM (SELECT l_orderkey * 10 + slot AS id, o_orderstatus FROM request_bodies
              WHERE slot < 3 AND faulty IS NULL) r, (VALUES (1), (2), (3)) AS places(k)""",
    "amount_row_checks": """
        SELECT transaction_id, slot, account_id, account_name,
          CASE WHEN account_id IS NULL AND account_name IS NULL THEN 'neither'
            WHEN account_id IS NOT NULL AND account_name IS NOT NULL THEN 'both'
            WHEN amount_to_pay < 0 THEN 'negative_share' WHEN amount_paid < 0 THEN 'negative_payment'
            WHEN count(*) OVER (PARTITION BY transaction_id, account_id, account_name) > 1 THEN 'repeated'
            ELSE 'ok' END AS reason
        FROM request_amounts""",
    "split_validation": _split_verdicts("transaction_amounts", "transactions", "id"),
    "request_verdicts": _REQUEST_VERDICTS,
    "split_remaining": f"""
        SELECT id, transaction_id, CAST(left_to_pay AS {TOTAL}) AS remaining_to_pay,
          CAST(left_paid AS {TOTAL}) AS remaining_paid,
          amount_to_pay BETWEEN 0 AND left_to_pay AND amount_paid BETWEEN 0 AND left_paid
            AND (id <> last OR (amount_to_pay = left_to_pay AND amount_paid = left_paid)) AS ok
        FROM (SELECT *, bill - coalesce(sum(amount_to_pay) OVER earlier, 0) AS left_to_pay,
                bill - coalesce(sum(amount_paid) OVER earlier, 0) AS left_paid
              FROM (SELECT *, sum(amount_to_pay) OVER (PARTITION BY transaction_id) AS bill,
                      max(id) OVER (PARTITION BY transaction_id) AS last FROM transaction_amounts) a
              WINDOW earlier AS (PARTITION BY transaction_id ORDER BY id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r""",
    "split_participant_rules": """
        SELECT t.id AS transaction_id,
          concat_ws(',', CASE WHEN g.transaction_id IS NULL THEN 'no_participants' END,
            CASE WHEN bill <= 0 THEN 'no_amount' END, CASE WHEN NOT first_own THEN 'first_not_own' END,
            CASE WHEN accounts_used > different THEN 'account_twice' END,
            CASE WHEN nameless THEN 'guest_without_name' END, CASE WHEN outsider THEN 'not_offered' END) AS reasons
        FROM transactions t LEFT JOIN (
          SELECT transaction_id, sum(amount_to_pay) AS bill, arg_min(coalesce(own, FALSE), place) AS first_own,
            count(account_id) AS accounts_used, count(DISTINCT account_id) AS different,
            bool_or(account_id IS NULL AND coalesce(account_name, '') = '') AS nameless,
            bool_or(account_id IS NOT NULL AND NOT coalesce(own, FALSE) AND NOT friend) AS outsider
          FROM split_rows GROUP BY transaction_id) g ON g.transaction_id = t.id""",
    "settlement_status": f"""
        SELECT id, transaction_id, CAST(amount_to_pay - amount_paid AS {TOTAL}) AS outstanding,
          CASE WHEN amount_paid > amount_to_pay THEN 'loaned' WHEN amount_paid < amount_to_pay THEN 'owed'
            ELSE 'settled' END AS status
        FROM transaction_amounts""",
    "apply_transaction_patches": "SELECT * FROM patched_transactions",
    "apply_amount_patches": "SELECT * FROM patched_amounts",
    "amount_patch_rejects": "SELECT * FROM rejected_patches WHERE reason IS NOT NULL",
    "post_edit_validation": "SELECT * FROM after_edit",
    "edit_verdicts": "SELECT * FROM edits_judged",
    "edit_sequence": f"""
        SELECT transaction_id * 4 + step AS seq, transaction_id, verdict, CAST(coalesce(n_amounts, 0) AS BIGINT) AS n_amounts,
          CAST(coalesce(paid, 0) AS {TOTAL}) AS paid FROM edit_steps""",
    "delete_transactions": """
        SELECT * FROM transactions WHERE id NOT IN (SELECT transaction_id FROM edits_judged WHERE verdict = 'deleted')""",
    "delete_transactions_amounts": """
        SELECT a.* FROM transaction_amounts a
        ANTI JOIN (SELECT transaction_id FROM edits_judged WHERE verdict = 'deleted') d USING (transaction_id)""",
    "delete_transactions_tags": """
        SELECT g.* FROM transaction_tags g
        ANTI JOIN (SELECT transaction_id FROM edits_judged WHERE verdict = 'deleted') d USING (transaction_id)""",
    "delete_transactions_reversal": f"""
        SELECT account_id, {total("CASE WHEN is_income THEN -amount_paid ELSE amount_paid END")} AS delta
        FROM transaction_amounts a JOIN transactions t ON t.id = a.transaction_id
        JOIN edits_judged j ON j.transaction_id = a.transaction_id
        WHERE verdict = 'deleted' AND account_id IS NOT NULL GROUP BY account_id""",
    "edited_ledger": f"""
        SELECT a.id AS account_id, a.user_id, CAST(opening_balance + coalesce(moved, 0) AS {TOTAL}) AS balance
        FROM accounts a LEFT JOIN edited_effects e ON e.account_id = a.id""",
    "edit_deltas": f"""
        SELECT b.account_id, CAST(opening_balance + coalesce(moved, 0) - balance AS {TOTAL}) AS delta
        FROM balances b JOIN accounts a ON a.id = b.account_id LEFT JOIN edited_effects e ON e.account_id = b.account_id
        WHERE opening_balance + coalesce(moved, 0) <> balance""",
    "visible_transactions": "SELECT user_id, transaction_id FROM visible",
    "transaction_search": "SELECT user_id, id, created_on FROM found",
    "transaction_search_by_category": """
        SELECT v.user_id, t.id, t.created_on FROM visible v JOIN transactions t ON t.id = v.transaction_id
        WHERE category = '2-HIGH' AND t.created_on BETWEEN TIMESTAMP '1996-07-01' AND TIMESTAMP '2000-01-01'""",
    "transaction_search_by_account": """
        SELECT DISTINCT a.user_id, t.id, t.created_on
        FROM transactions t JOIN transaction_amounts m ON m.transaction_id = t.id JOIN accounts a ON a.id = m.account_id
        WHERE m.account_id = 15""",
    "transaction_search_all_filters": f"""
        SELECT DISTINCT a.user_id, t.id, t.created_on
        FROM transactions t JOIN transaction_amounts m ON m.transaction_id = t.id JOIN accounts a ON a.id = m.account_id
        JOIN transaction_tags g ON g.transaction_id = t.id
        WHERE m.account_id = 15 AND a.user_id = 8 AND category = '1-URGENT' AND {same_tag("tag")} = 'ring'
          AND t.created_on BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '2001-01-01'""",
    "search_filter_checks": "SELECT * EXCLUDE (wanted_tags) FROM filters_read",
    "search_batch": "SELECT seq, id, created_on FROM searched",
    "search_batch_pages": """
        SELECT seq, id, created_on, rank, total
        FROM (SELECT s.*, page_no, page_limit, row_number() OVER (PARTITION BY seq ORDER BY created_on DESC, id DESC) AS rank,
                count(*) OVER (PARTITION BY seq) AS total
              FROM searched s JOIN filters_read USING (seq)) r
        WHERE rank > (page_no - 1) * page_limit AND rank <= page_no * page_limit""",
    "transactions_with_all_tags": "SELECT transaction_id FROM tagged",
    "transaction_search_total": """
        SELECT user_id, count(DISTINCT id) AS total, CAST(ceil(count(DISTINCT id) / 20.0) AS BIGINT) AS total_pages
        FROM found GROUP BY user_id""",
    "transaction_pages": """
        SELECT user_id, id, created_on, rank, CAST(ceil(rank / 20.0) AS BIGINT) AS page_no, total
        FROM (SELECT v.user_id, t.id, t.created_on,
                row_number() OVER (PARTITION BY v.user_id ORDER BY t.created_on DESC, t.id DESC) AS rank,
                count(*) OVER (PARTITION BY v.user_id) AS total
              FROM visible v JOIN transactions t ON t.id = v.transaction_id) r""",
    "transaction_page": """
        SELECT v.user_id, t.id, t.created_on FROM visible v JOIN transactions t ON t.id = v.transaction_id
        WHERE v.user_id = 1 ORDER BY t.created_on DESC, t.id DESC LIMIT 5 OFFSET 10""",
    "transaction_documents": """
        SELECT t.id AS transaction_id, category, is_income, description, notes, created_on,
          coalesce(amounts, '') AS amounts, coalesce(tags, '') AS tags
        FROM transactions t
        LEFT JOIN (SELECT transaction_id, string_agg(concat_ws(':', CAST(id AS VARCHAR),
              coalesce(CAST(account_id AS VARCHAR), account_name), CAST(amount_to_pay AS VARCHAR),
              CAST(amount_paid AS VARCHAR)), ',' ORDER BY id) AS amounts
            FROM transaction_amounts GROUP BY transaction_id) a ON a.transaction_id = t.id
        LEFT JOIN (SELECT transaction_id, string_agg(concat_ws(':', CAST(id AS VARCHAR), tag), ',' ORDER BY id) AS tags
            FROM transaction_tags GROUP BY transaction_id) g ON g.transaction_id = t.id""",
    "documents_as_json": """
        SELECT t.id AS transaction_id, category, is_income, description, notes, created_on,
          coalesce(amounts, '') AS amounts, coalesce(tags, '') AS tags
        FROM transactions t
        LEFT JOIN (SELECT transaction_id, string_agg(concat_ws(':', CAST(id AS VARCHAR),
              coalesce(CAST(account_id AS VARCHAR), account_name), CAST(amount_to_pay AS VARCHAR),
              CAST(amount_paid AS VARCHAR)), ',' ORDER BY id) AS amounts
            FROM transaction_amounts GROUP BY transaction_id) a ON a.transaction_id = t.id
        LEFT JOIN (SELECT transaction_id, string_agg(concat_ws(':', CAST(id AS VARCHAR), tag), ',' ORDER BY id) AS tags
            FROM transaction_tags GROUP BY transaction_id) g ON g.transaction_id = t.id""",
    "transaction_list": """
        SELECT 2 AS page, 5 AS "limit", total, t.id AS transaction_id, category, is_income, description, notes, created_on,
          coalesce((SELECT string_agg(concat_ws(':', CAST(id AS VARCHAR),
              coalesce(CAST(account_id AS VARCHAR), account_name), CAST(amount_to_pay AS VARCHAR),
              CAST(amount_paid AS VARCHAR)), ',' ORDER BY id)
            FROM transaction_amounts a WHERE a.transaction_id = t.id), '') AS amounts,
          coalesce((SELECT string_agg(concat_ws(':', CAST(id AS VARCHAR), tag), ',' ORDER BY id)
            FROM transaction_tags g WHERE g.transaction_id = t.id), '') AS tags
        FROM transactions t JOIN (
          SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY created_on DESC, id DESC) AS place
          FROM transactions JOIN visible v ON v.transaction_id = id WHERE v.user_id = 1) p
          ON p.id = t.id AND place BETWEEN 6 AND 10""",
    "amount_labels": """
        SELECT t.creator_id AS viewer_id, t.id AS transaction_id, m.id,
          coalesce(account_name, CASE WHEN a.user_id = t.creator_id OR e.lo IS NOT NULL THEN a.name END) AS label,
          CASE WHEN a.user_id = t.creator_id OR e.lo IS NOT NULL THEN username END AS owner_name,
          amount_paid, amount_to_pay
        FROM transactions t JOIN transaction_amounts m ON m.transaction_id = t.id
        LEFT JOIN accounts a ON a.id = m.account_id LEFT JOIN users u ON u.id = a.user_id
        LEFT JOIN edges e ON e.lo = least(t.creator_id, a.user_id) AND e.hi = greatest(t.creator_id, a.user_id)""",
    "tag_list_text": """
        SELECT transaction_id, string_agg(tag, ', ' ORDER BY id) AS text FROM transaction_tags GROUP BY transaction_id""",
    "add_tags": "SELECT * FROM additions_judged",
    "add_tags_result": """
        SELECT id, transaction_id, tag FROM transaction_tags
        UNION ALL
        SELECT (SELECT max(id) FROM transaction_tags) + seq, transaction_id, tag
        FROM additions_judged WHERE verdict = 'accepted'""",
    "tags_of_transactions": """
        SELECT t.creator_id AS user_id, g.transaction_id, g.id, g.tag
        FROM transactions t JOIN visible v ON v.user_id = t.creator_id AND v.transaction_id = t.id
        JOIN transaction_tags g ON g.transaction_id = t.id""",
    "remove_tags": "SELECT * FROM removals_judged",
    "remove_tags_result": """
        SELECT id, transaction_id, tag FROM transaction_tags
        WHERE id NOT IN (SELECT tag_id FROM removals_judged WHERE verdict = 'removed')""",
    "duplicate_tags": f"""
        SELECT transaction_id, {same_tag("tag")} AS tag, count(*) AS n FROM transaction_tags
        GROUP BY transaction_id, {same_tag("tag")} HAVING count(*) > 1""",
    "friend_list": """
        SELECT m.user_id, m.friend_id, username, m.created_on,
          row_number() OVER (PARTITION BY m.user_id ORDER BY m.created_on DESC, m.friend_id DESC) AS position
        FROM mutual m JOIN users u ON u.id = m.friend_id""",
    "are_friends": """
        SELECT m.id, t.creator_id AS user_id, a.user_id AS other_id,
          EXISTS (SELECT 1 FROM edges e WHERE e.lo = least(t.creator_id, a.user_id)
                  AND e.hi = greatest(t.creator_id, a.user_id)) AS friends
        FROM transaction_amounts m JOIN transactions t ON t.id = m.transaction_id JOIN accounts a ON a.id = m.account_id""",
    "incoming_requests": """
        SELECT r.friend_id AS user_id, r.user_id AS sender_id, username, r.created_on,
          row_number() OVER (PARTITION BY r.friend_id ORDER BY r.created_on DESC, r.user_id DESC) AS position
        FROM friend_requests r JOIN users u ON u.id = r.user_id""",
    "friend_request_admission": """
        SELECT seq, user_id, identifier, friend_id,
          CASE WHEN refusal IS NOT NULL THEN refusal
            WHEN row_number() OVER (PARTITION BY least(user_id, friend_id), greatest(user_id, friend_id), refusal IS NULL
              ORDER BY seq) = 1 THEN 'accepted' ELSE 'pending' END AS verdict
        FROM (SELECT i.*, CASE WHEN i.friend_id IS NULL THEN 'not_found' WHEN i.friend_id = i.user_id THEN 'to_oneself'
                WHEN e.lo IS NOT NULL THEN 'already_friends' WHEN p.lo IS NOT NULL THEN 'pending' END AS refusal
              FROM identified i
              LEFT JOIN edges e ON e.lo = least(i.user_id, i.friend_id) AND e.hi = greatest(i.user_id, i.friend_id)
              LEFT JOIN (SELECT DISTINCT least(user_id, friend_id) AS lo, greatest(user_id, friend_id) AS hi
                         FROM friend_requests) p
                ON p.lo = least(i.user_id, i.friend_id) AND p.hi = greatest(i.user_id, i.friend_id)) r""",
    "friend_request_resolution": "SELECT * FROM responses_judged",
    "friend_request_resolution_friends": """
        SELECT user_id, friend_id, created_on FROM friends
        UNION ALL SELECT user_id, friend_id, responded_on FROM responses_judged WHERE verdict = 'accepted'""",
    "friend_request_resolution_requests": """
        SELECT r.user_id, r.friend_id, r.created_on FROM friend_requests r
        WHERE NOT EXISTS (SELECT 1 FROM responses_judged j WHERE j.verdict IN ('accepted', 'rejected')
                          AND j.user_id = r.friend_id AND j.friend_id = r.user_id)""",
    "remove_friends": """
        SELECT user_id, friend_id, created_on FROM friends f
        WHERE NOT EXISTS (SELECT 1 FROM friend_removals r WHERE least(r.user_id, r.friend_id) = least(f.user_id, f.friend_id)
                          AND greatest(r.user_id, r.friend_id) = greatest(f.user_id, f.friend_id))""",
    "remove_friends_verdicts": """
        SELECT seq, user_id, friend_id, CASE WHEN e.lo IS NOT NULL AND row_number() OVER (
            PARTITION BY least(user_id, friend_id), greatest(user_id, friend_id) ORDER BY seq) = 1
          THEN 'removed' ELSE 'not_friends' END AS verdict
        FROM friend_removals LEFT JOIN edges e ON e.lo = least(user_id, friend_id) AND e.hi = greatest(user_id, friend_id)""",
    "friendship_replay": _REPLAY,
    "delete_users_cascade": "SELECT * FROM users WHERE id NOT IN (SELECT user_id FROM leaving_users)",
    "delete_users_cascade_accounts": """
        SELECT * FROM accounts WHERE user_id NOT IN (SELECT user_id FROM leaving_users)""",
    "delete_users_cascade_friends": """
        SELECT * FROM friends WHERE user_id NOT IN (SELECT user_id FROM leaving_users)
          AND friend_id NOT IN (SELECT user_id FROM leaving_users)""",
    "delete_users_cascade_requests": """
        SELECT * FROM friend_requests WHERE user_id NOT IN (SELECT user_id FROM leaving_users)
          AND friend_id NOT IN (SELECT user_id FROM leaving_users)""",
    "delete_users_cascade_amounts": """
        SELECT m.id, transaction_id, CASE WHEN l.user_id IS NULL THEN account_id END AS account_id,
          CASE WHEN l.user_id IS NULL THEN account_name ELSE a.name END AS account_name,
          amount_to_pay, amount_paid, m.created_on
        FROM transaction_amounts m LEFT JOIN accounts a ON a.id = m.account_id
        LEFT JOIN leaving_users l ON l.user_id = a.user_id""",
    "friend_directory": """
        SELECT m.user_id, m.friend_id, username, count(a.id) AS accounts, count(a.id) > 0 AS offered
        FROM mutual m JOIN users u ON u.id = m.friend_id LEFT JOIN accounts a ON a.user_id = m.friend_id
        GROUP BY m.user_id, m.friend_id, username""",
    "friend_picker": """
        SELECT m.friend_id, username, a.id AS account_id, a.name
        FROM mutual m JOIN users u ON u.id = m.friend_id JOIN accounts a ON a.user_id = m.friend_id WHERE m.user_id = 8""",
    "friend_pickers": """
        SELECT m.user_id, m.friend_id, username, a.id AS account_id, a.name
        FROM mutual m JOIN users u ON u.id = m.friend_id JOIN accounts a ON a.user_id = m.friend_id""",
    "incoming_requests_of_one": """
        SELECT r.friend_id AS user_id, r.user_id AS sender_id, username, r.created_on
        FROM friend_requests r JOIN users u ON u.id = r.user_id WHERE r.friend_id = 13""",
    "friend_list_of_one": """
        SELECT m.user_id, m.friend_id, username FROM mutual m JOIN users u ON u.id = m.friend_id WHERE m.user_id = 8""",
    "user_registration_checks": """
        SELECT seq, username, email,
          CASE WHEN refusal IS NOT NULL THEN refusal
            WHEN row_number() OVER (PARTITION BY lower(username), refusal IS NULL ORDER BY seq) = 1 THEN 'ok'
            ELSE 'taken' END AS verdict
        FROM (SELECT n.seq, n.username, n.email,
                CASE WHEN length(n.username) NOT BETWEEN 3 AND 255
                       OR NOT regexp_full_match(n.username, '[a-zA-Z0-9_]+') THEN 'bad_username'
                  WHEN n.email LIKE '.%' OR n.email LIKE '%..%' OR NOT regexp_full_match(n.email,
                    '[A-Za-z0-9_''+\\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\\.)+[A-Za-z]{2,}') THEN 'bad_email'
                  WHEN EXISTS (SELECT 1 FROM users u WHERE u.username = lower(n.username))
                    OR EXISTS (SELECT 1 FROM users u WHERE u.email = n.email) THEN 'taken' END AS refusal
              FROM new_users n) r""",
    "identifier_lookup": "SELECT seq, identifier, friend_id AS found_id FROM identified",
    "users_by_id": """
        SELECT i.id, username, email, created_on, u.id IS NOT NULL AS found
        FROM (SELECT o_orderkey AS id FROM orders UNION SELECT o_custkey + 1 FROM orders) i
        LEFT JOIN users u ON u.id = i.id""",
    "session_claims_audit": _audit(""),
    "session_claims_audit_refresh": _audit("WHEN NOT refresh THEN 'not_refresh'"),
    "report_category_month": f"""
        SELECT user_id, month, category, is_income, {total("amount_paid")} AS paid
        FROM reported GROUP BY user_id, month, category, is_income""",
    "report_by_tag": f"""
        SELECT user_id, month, tag, is_income, {total("amount_paid")} AS paid
        FROM reported r JOIN (SELECT DISTINCT transaction_id, {same_tag("tag")} AS tag FROM transaction_tags) g
          ON g.transaction_id = r.transaction_id
        GROUP BY user_id, month, tag, is_income""",
    "loan_positions": f"""
        SELECT *, CASE WHEN position > 0 THEN 'loaned' WHEN position < 0 THEN 'owed' ELSE 'settled' END AS status
        FROM (SELECT account_id, CASE WHEN account_id IS NULL THEN creator_id END AS guest_of,
                CASE WHEN account_id IS NULL THEN account_name END AS guest_name,
                {total("amount_paid - amount_to_pay")} AS position
              FROM transaction_amounts JOIN transactions t ON t.id = transaction_id
              GROUP BY 1, 2, 3) p""",
    "stream_balances": _DELTAS,
    "stream_direction_changes": _TURNED,
    "stream_split_validation": _REQUEST_VERDICTS,
    "stream_split_validation_headers": f"""
        SELECT h.* EXCLUDE (shape) FROM request_headers h JOIN ({_REQUEST_VERDICTS}) v ON v.transaction_id = h.id WHERE verdict = 'ok'""",
    "stream_split_validation_amounts": f"""
        SELECT a.* FROM request_amounts a JOIN ({_REQUEST_VERDICTS}) v USING (transaction_id) WHERE verdict = 'ok'""",
    "stream_split_validation_tags": f"""
        SELECT transaction_id, CAST(k AS BIGINT) AS slot, CASE k WHEN 1 THEN 'bill' WHEN 2 THEN ' Bill' ELSE o_orderstatus END AS tag
        FROM (SELECT l_orderkey * 10 + slot AS transaction_id, o_orderstatus FROM request_bodies
              WHERE slot < 3 AND faulty IS NULL) r
        JOIN ({_REQUEST_VERDICTS}) v USING (transaction_id), (VALUES (1), (2), (3)) AS places(k) WHERE verdict = 'ok'""",
    "stream_split_validation_quarantine": f"""
        SELECT transaction_id AS request_id, verdict FROM ({_REQUEST_VERDICTS}) v WHERE verdict <> 'ok'""",
    "stream_balances_late": f"""
        SELECT change_id, changed_on, transaction_id FROM amount_changes WHERE {_straggles("change_id", "changed_on", "amount_changes", 400)}""",
    "stream_friendship_state": f"""
        SELECT lo, hi, state, coalesce(late, 0) AS late FROM ({_REPLAY}) r LEFT JOIN (
          SELECT least(actor_id, target_id) AS lo, greatest(actor_id, target_id) AS hi, count(*) AS late FROM friend_actions
          WHERE {_straggles("seq", "ts", "friend_actions", 10)} GROUP BY 1, 2) l USING (lo, hi)""",
    "stream_friendship_late": f"SELECT * FROM friend_actions WHERE {_straggles('seq', 'ts', 'friend_actions', 10)}",
}


def _needed(text: str, names: list[str]) -> list[str]:
    """The views `text` uses, each after the ones it is made from."""
    for name, body in VIEWS.items():
        if name not in names and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            inner = body if name != "played" else body.replace("FROM played", "FROM it")
            for found in _needed(inner, names):
                if found not in names:
                    names.append(found)
            if name not in names:
                names.append(name)
    return names


def sql(name: str) -> str:
    views = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in _needed(CHECKS[name], []))
    return f"WITH RECURSIVE {views}\n{CHECKS[name]}" if views else CHECKS[name]
