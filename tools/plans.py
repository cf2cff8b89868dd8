"""Scan the physical plans of all registered queries for shapes that do not scale."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gavel.plans import load_all  # noqa: E402
from gavel.session import get_session  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit")


def findings(plan: str) -> list[str]:
    out = [b for b in BAD if b in plan]
    for m in re.finditer(r"^[\s:+\-]*Window \[(.*)\]$", plan, re.M):
        # A window without PARTITION BY shows only two bracket groups.
        if re.search(r"windowspecdefinition\((?:[^,()]+#\d+L? (?:ASC|DESC)|specifiedwindowframe)", m.group(1)):
            out.append("unpartitioned window")
    return sorted(set(out))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = get_session("plans", "local[8]", spark__sql__shuffle__partitions="8", spark__sql__autoBroadcastJoinThreshold="-1")
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in load_all().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        plan = q.plan(spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = findings(plan)
        if hits:
            print(f"{name}: {', '.join(hits)}", flush=True)


if __name__ == "__main__":
    main()
