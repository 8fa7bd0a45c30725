"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores.  Each query runs twice into a noop sink, plan building and size checks included; the
second run counts.  ``BENCH_QUERIES`` may name others, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "f1_ignore",
    "f4_text_check",
    "p1_decode",
    "p6_line_count",
    "p9_metadata",
    "o1_path_order",
    "j1_stale",
    "j4_project_root",
    "a2_pack",
    "a2_pack_parts",
    "a2_pack_hot_session",
    "a9_tree_lines",
    "w1_drop_repeats",
    "t1_replay",
    "t1_replay_split",
    "x1_symbols",
    "c1_pack_with_tree",
    "c2_python_symbols",
    "c3_update_selection",
    "c6_check_stale",
]


def main() -> None:
    from registry import QUERIES
    from sheaf.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "sheaf-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir.rstrip("/")).name,
    }))


if __name__ == "__main__":
    main()
