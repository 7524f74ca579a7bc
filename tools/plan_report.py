"""Write PLANS.md: the executed (AQE-final) physical plan summary of every query.

Usage:  python tools/plan_report.py [sf_dir] > PLANS.md

For each batch query: exchanges (shuffles / broadcasts), join strategies,
aggregate implementations, window limits, and each Parquet scan's read
schema and pushed filters.  Stream and sink queries run their own jobs;
their read-back plan is shown.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

OPS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit",
       "Window", "Generate", "Expand", "Union")


def summarize(spark, df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    ops = Counter()
    for op in OPS:
        if op == "Window":
            ops[op] = len(re.findall(r"\bWindow \[", final))
        else:
            ops[op] = len(re.findall(rf"\b{op}[ (\[]", final))
    ops["shuffle exchanges"] = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                              r"Exchange SinglePartition|Exchange RoundRobin", final))
    ops["broadcast exchanges"] = len(re.findall(r"BroadcastExchange", final))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    scans = []
    for block in re.findall(r"Scan parquet[^\n]*\n(?:[^\n]+\n)+?ReadSchema: [^\n]+", text):
        loc = re.search(r"Location: \w+ \[[^\]]*?([\w.]+\.parquet|[^/\]]+)\]", block)
        pushed = re.search(r"PushedFilters: (\[[^\n]*\])", block)
        schema = re.search(r"ReadSchema: ([^\n]+)", block).group(1)
        scans.append((loc.group(1) if loc else "?", schema, pushed.group(1) if pushed else "[]"))
    return {"ops": {k: v for k, v in ops.items() if v}, "scans": sorted(set(scans))}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from keelson.plans.catalog import QUERIES
    from keelson.session import build_session
    spark = build_session()
    print(f"# Physical plans (AQE final) at `{sf_dir}`\n")
    print("Generated by `tools/plan_report.py`. Counts are operators in the executed plan;")
    print("scans list the Parquet read schema (column pruning) and pushed filters.\n")
    for name, fn in QUERIES.items():
        s = summarize(spark, fn(spark, sf_dir))
        ops = ", ".join(f"{k} {v}" for k, v in s["ops"].items()) or "row-local only"
        print(f"## {name}\n\n- operators: {ops}")
        for loc, schema, pushed in s["scans"]:
            print(f"- scan `{loc}`: `{schema}`" + (f", pushed `{pushed}`" if pushed != "[]" else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
