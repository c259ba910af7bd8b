"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder with the given tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from touchpath.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "channel_credit",
    "attribution_detail",
    "orders_attribution",
    "orders_windows",
    "report_day_channel",
    "orders_step",
    "orders_step_variation",
    "orders_kpi",
    "qc_report",
    "cumulative_relative",
    "composition_all",
    "topk_across_waves",
    "route_report",
    "identity_fallback",
    "match_by_channel",
    "event_export",
    "measures_by_wave",
    "calendar",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Start-up of the JVM and its compiler is not part of a query.
    QUERIES["channel_credit"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
