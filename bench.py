"""Benchmark: headline queries over one sample folder, one JSON line of seconds.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from eventrail.plans.queries import QUERIES
from eventrail.session import local_session

HEADLINE = [
    "v_default_rule_counts",
    "v_rule_book",
    "q_replay_targets",
    "q_quarantine_codes",
    "x_project_processors",
    "p_enriched_events",
    "p_parquet_projection",
    "x_python_processor",
    "a_issue_counts",
    "a_admitted_log",
    "w_lsn_gaps",
    "w_sink_batches",
    "m_events_total",
    "f_scalar_functions",
    "t_stream_replay",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    # The samples have one row group each; a real log has many files.
    spark.conf.set("eventrail.sample.partitions", cores)
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    seconds, planning = {}, {}
    for name in HEADLINE:
        started = time.perf_counter()
        df = QUERIES[name](spark, folder)
        df._jdf.queryExecution().executedPlan()
        # Building and planning; for queries that stage or stream, also the jobs they run meanwhile.
        planning[name] = round(time.perf_counter() - started, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    # Replay: decode, validate, route and write every record of the log to its sinks.
    replayed = round(events / seconds["t_stream_replay"])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "planning": planning,
                "replay_records_per_sec": replayed,
            }
        )
    )


if __name__ == "__main__":
    main()
