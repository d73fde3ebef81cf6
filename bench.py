"""Headline timings. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query starts from the parquet tables: nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from checks.queries import QUERIES, Book
    from ledgerloom.config import threshold_frame
    from ledgerloom.operators.vouchers import LedgerFrames
    from ledgerloom.plans import fixtures
    from ledgerloom.plans.review import build_findings
    from ledgerloom.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1000))

    def review(lines, use_model=False):
        return lambda: run(build_findings(
            LedgerFrames(lines, overrides=threshold_frame(spark, fixtures.LEDGER_THRESHOLDS)), use_model=use_model
        ))

    def registered(name):
        def go():
            Book._open.clear()
            run(QUERIES[name](spark, sf))

        return go

    plans = {
        "review_events": review(fixtures.event_lines(spark, sf)),
        "review_orders": review(fixtures.order_lines(spark, sf)),
        "review_both_with_model": review(fixtures.both_lines(spark, sf), True),
        **{
            name: registered(name)
            for name in (
                "adapt_sap_corpus", "validate_lines", "drop_unusable_rows", "voucher_view", "pair_counts",
                "sig_duplicate_entry", "sig_rare_pair", "sig_amount_outlier", "account_profile", "benford_by_account",
                "voucher_features", "ledger_digest", "similarity_rank", "trial_balance",
            )
        },
    }
    times = {}
    for name, go in plans.items():
        start = time.time()
        go()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
