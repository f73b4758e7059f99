"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times; the median counts. Results go to
the noop sink, so whole results are computed and none is collected.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.plans import load
from ledgerlark.session import build_session

HEADLINE = [
    "usage_daily", "usage_rollup_day", "usage_rollup_labelled", "usage_projection", "usage_projection_rollup_day", "usage_cost_monthly_by_campaign", "usage_token_summary",
    "billing_workspace_rollup", "billing_week_snapshot", "billing_invoice_lines",
    "dashboard_summary", "dashboard_email_performance", "dashboard_stats", "dashboard_task_counts",
    "funnel_conversion", "funnel_top_industries",
    "campaign_metrics", "outreach_followup_eligible", "outreach_filter_companies",
    "identity_soft_merge", "tasks_cancel_duplicates",
    "deals_project", "deals_readiness", "deals_attach_activity",
    "onboarding_dropouts", "contacts_export_template", "inbox_thread_summary",
    "search_match_chunks", "search_hybrid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "ledgerlark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


main()
