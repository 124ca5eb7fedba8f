"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Each query is run once to warm up and
then BENCH_RUNS times; the median is reported. The derived ledger tables are written once before,
and that time is reported apart. BENCH_QUERIES (comma-separated, or "all") picks other queries.
"""

import json
import os
import statistics
import time

from pursebook import catalog
from pursebook.session import local_session
from pursebook.sources.derive import TABLES, Ledger

HEADLINE = [
    "account_balances",
    "balance_delta_from_changes",
    "refresh_balances",
    "visible_accounts",
    "split_validation",
    "split_remaining",
    "request_verdicts",
    "edit_verdicts",
    "edited_ledger",
    "transaction_search",
    "transaction_pages",
    "transaction_documents",
    "amount_labels",
    "add_tags",
    "friend_list",
    "friend_request_admission",
    "friendship_replay",
    "user_registration_checks",
    "session_claims_audit",
    "report_category_month",
    "report_by_tag",
    "loan_positions",
    "stream_balances",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "pursebook-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ledger = Ledger(spark, folder)

    started = time.perf_counter()
    for table in TABLES:
        ledger[table]
    derived = time.perf_counter() - started

    def timed(name: str) -> float:
        begun = time.perf_counter()
        catalog.QUERIES[name](ledger).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    seconds = {}
    for name in names:
        timed(name)
        repeats = 1 if name.startswith("stream_") else runs
        seconds[name] = round(statistics.median(timed(name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "derive_tables_sec": round(derived, 3),
                "with_derivation_sec": round(sum(seconds.values()) + derived, 3),
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
