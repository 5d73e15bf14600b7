"""Summarise the final (adaptive) physical plan of the headline queries.

Writes a Markdown table: exchanges, joins by strategy, windows, Python
grouped maps, codegen stages, and whether filters reach the scans.
Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from spindle.plans import queries as Q  # noqa: E402
from spindle.session import local_session  # noqa: E402

NODES = [("Exchange", "Exchange"), ("BroadcastX", "BroadcastExchange"), ("Reused", "ReusedExchange"),
         ("BHJ", "BroadcastHashJoin"), ("SMJ", "SortMergeJoin"), ("BNLJ", "BroadcastNestedLoopJoin"),
         ("Window", "Window"), ("PyMap", "(?:FlatMapGroupsIn(?:Pandas|Arrow)|MapInArrow|MapInPandas)"), ("HashAgg", "HashAggregate")]


def summary(df):
    df.collect()  # runs this DataFrame's own adaptive plan to its final form
    qe = df._jdf.queryExecution()
    text = qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = text.split("== Final Plan ==", 1)[-1].split("== Initial Plan ==", 1)[0]  # final adaptive plan
    lines = text.splitlines()
    row = {k: len(re.findall(rf"(?<![A-Za-z]){name}(?: [A-Za-z ]+)? \(\d+\)", tree)) for k, name in NODES}
    row["Codegen"] = len(set(re.findall(r"\*\((\d+)\)", qe.executedPlan().toString())))
    row["semi"] = "LeftSemi" in text
    row["pushed"] = sorted({m for m in re.findall(r"PushedFilters: \[([^\]]+)\]", text)})[:2]
    row["partition"] = any(re.search(r"PartitionFilters: \[[^\]]*rat", ln) for ln in lines)
    return row


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    print(f"# Plans of the headline queries (final adaptive plans, {os.path.basename(sf)}, local[8], "
          "16 shuffle partitions)\n")
    print("Counts are physical operators in the executed plan (AQE final plan; exchanges include the "
          "explicit repartitions of grouped maps).\n")
    cols = [k for k, _ in NODES] + ["Codegen"]
    print("| query | " + " | ".join(cols) + " | semi join | rat/dt partition filter | pushed filters (sample) |")
    print("|" + " --- |" * (len(cols) + 4))
    for name in HEADLINE:
        r = summary(Q.QUERIES[name](spark, sf))
        print(f"| `{name}` | " + " | ".join(str(r[c]) for c in cols)
              + f" | {'yes' if r['semi'] else ''} | {'yes' if r['partition'] else ''} | "
              + "; ".join(f"`{p[:60]}`" for p in r["pushed"]) + " |")


if __name__ == "__main__":
    main()
