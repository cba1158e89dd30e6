"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to the end (a write to the ``noop`` sink). One query runs before
the clock starts, to load the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywright.catalog.queries import QUERIES  # noqa: E402
from tallywright.session import build_session  # noqa: E402

HEADLINES = (
    "sales_monthly",
    "sales_fact",
    "first_invoices",
    "ledger_fact",
    "signed_amount",
    "noise_profile",
    "payroll_accrual_monthly",
    "payroll_hybrid_monthly",
    "payroll_row_apportioned",
    "method_reconciliation",
    "expenses_monthly",
    "movements_fact",
    "pnl_long",
    "pnl_pivot",
    "pnl_with_result",
    "margin_monthly",
    "statement_rows",
    "topn_counterparty",
    "contact_report",
    "supplier_report",
    "account_activity",
    "account_inventory",
    "date_shift_matrix",
    "margin_from_purchases",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("sales_monthly")
    timings = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in HEADLINES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
