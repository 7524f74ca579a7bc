"""Write SKEW.md: how much of a hot key reaches one task after each shuffle.

Usage:  python tools/skew_report.py [sf_dir] > SKEW.md

The sf events are rewritten so that every third event belongs to user 0
(a third of all rows on one key).  Each event-family query runs into the
``noop`` sink with Spark's event log on (a fresh scratch folder).  From the
log, for every stage that reads a shuffle: total records read, the largest
single task's records, and that task's share.  A hot key that reached one
task as raw rows would show up as a share near 1/3 of the query's input.
For contrast, the same A3 result is computed the naive way — shuffle the raw
rows by user first (``repartition``), then aggregate.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

QUERIES = ["a3_resolve_properties", "a4_render_properties", "a6_first_success_within", "w1_bounded_attempts"]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    from keelson.plans.catalog import QUERIES as ALL
    from keelson.plans.properties_queries import event_writes
    from keelson.operators.aggregates import resolve_properties
    from keelson.session import build_session
    from keelson.sources.tables import Tables, table_path

    scratch = tempfile.mkdtemp(prefix="keelson-skew-")
    logs = os.path.join(scratch, "eventlog")
    os.makedirs(logs)
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logs,
                                 "spark.eventLog.compress": "false",
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    sc = spark.sparkContext

    ev = Tables(spark, sf_dir).events
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long"))
                        .otherwise(F.col("user_id")))
    data = os.path.join(scratch, "data")
    hot.repartition(8).write.parquet(table_path(data, "events") + ".d")
    os.makedirs(data, exist_ok=True)
    # Queries read one ``events.parquet`` path; a directory of parts works the same.
    shutil.move(table_path(data, "events") + ".d", table_path(data, "events"))
    n_rows = spark.read.parquet(table_path(data, "events")).count()
    n_hot = spark.read.parquet(table_path(data, "events")).where("user_id = 0").count()

    runs = [(q, lambda q=q: ALL[q](spark, data)) for q in QUERIES]

    def naive_a3():
        w = event_writes(Tables(spark, data)).repartition(8, "user_id")
        return resolve_properties(w, "user_id", "event_type", "value", order=["ts", "event_id"])
    runs.append(("naive: repartition(user_id) then A3", naive_a3))

    for name, build in runs:
        sc.setJobDescription(name)
        build().write.format("noop").mode("overwrite").save()
    sc.setJobDescription(None)
    spark.stop()

    stage_query, stage_tasks = {}, defaultdict(list)
    for path in sorted(glob.glob(os.path.join(logs, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (e.get("Properties") or {}).get("spark.job.description")
                    for sid in e.get("Stage IDs", []):
                        if desc:
                            stage_query[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    stage_tasks[e["Stage ID"]].append(rd)

    print(f"# Skew report: one key with a third of the rows\n")
    print(f"Input: `{sf_dir}` events rewritten so user 0 holds {n_hot} of {n_rows} rows "
          f"({n_hot / n_rows:.0%}). Generated by `tools/skew_report.py` from Spark's event log.\n")
    print("For each stage that reads a shuffle: records read in total, by the largest task, and")
    print("that task's records as a share of the query's input rows.\n")
    print("| query | stage | tasks | shuffle records read | largest task | largest task / input rows |")
    print("| --- | --- | --- | --- | --- | --- |")
    for sid in sorted(stage_tasks):
        recs = stage_tasks[sid]
        total = sum(recs)
        if total == 0 or sid not in stage_query:
            continue
        print(f"| {stage_query[sid]} | {sid} | {len(recs)} | {total} | {max(recs)} | {max(recs) / n_rows:.4f} |")


if __name__ == "__main__":
    main(sys.argv)
