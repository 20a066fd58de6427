"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitlens.plans import QUERIES  # noqa: E402
from pitlens.plans.registry import runner  # noqa: E402
from pitlens.session import local_session  # noqa: E402

HEADLINE = [
    "revenue_growth_ranked", "factor_library", "score_universe", "score_panel_many_dates", "restatements_resolved",
    "price_on_or_before", "typical_move", "move_after_disclosure", "evidence_baseline", "norms_by_hierarchy",
    "incidence_excess", "restated_findings", "evaluate_findings", "precedents", "backtest_factor_results",
    "measured_arm_books", "newey_west_t", "bootstrap_interval", "portfolio_totals", "build_briefs", "extract_section",
    "quotes_in_source", "text_search", "score_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "pitlens-bench")
    names = sys.argv[1:] or [n for n in HEADLINE if n in QUERIES]
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        runner(QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
