"""Look for plan shapes that would not survive large data.

Prints the queries whose physical plan holds a cartesian or nested-loop join,
a Python worker, or a broadcast that was forced by a hint.
"""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallymark.plans import load_catalogue  # noqa: E402
from tallymark.session import build_session  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "Window [] ", "SinglePartition, ENSURE_REQUIREMENTS")


def main() -> None:
    spark = build_session("plans", "local[4]", 4, {"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for name, q in load_catalogue().items():
        df = q.build(spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().executedPlan().toString()
        found = [b for b in BAD if b in text]
        if found:
            print(name, found)
    print("done")


if __name__ == "__main__":
    main()
