"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Analytical queries run on the silver tables, whose one-time build is reported as
``build_*``. Ingestion and redaction queries write to a sink that discards rows,
so the time is the work and not the transfer to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import queries  # noqa: E402
from usagelake.lake import Lake  # noqa: E402
from usagelake.session import local_session  # noqa: E402

COLLECTED = (
    "orgs", "metric_breakdowns", "event_breakdowns", "cost_by_model", "cost_timeseries", "adoption", "cost_by_user_top", "people",
    "person_tools", "model_top_users", "tools_list", "tool_latency", "agents_list", "teams", "team_members", "plugins",
    "hooks_by_event", "reliability_totals", "errors_by_day", "env_versions", "efficiency", "friction",
    "session_duration", "overview_kpis", "period_delta", "cost_pivot_top4",
)
DISCARDED = (
    "read_otlp_metrics", "read_otlp_logs", "metric_to_row", "event_to_row", "replace_by_key", "scan_pii",
    "redact_fields", "cumulative_to_delta",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    lake, times, registered = Lake(spark, sf_dir), {}, queries()

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    timed("build_metrics", lake.metrics)
    timed("build_events", lake.events)
    timed("land_metric_requests", lake.metric_requests)
    timed("land_log_requests", lake.log_requests)
    for name in COLLECTED:
        timed(name, lambda n=name: registered[n](spark, sf_dir).collect())
    for name in DISCARDED:
        timed(name, lambda n=name: registered[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    answered = [*COLLECTED, *DISCARDED]
    report = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times[n] for n in answered), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(report), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
