"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Results go to the no-op sink: everything is computed,
nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallymark.plans import load_catalogue  # noqa: E402
from tallymark.session import build_session  # noqa: E402

HEADLINE = [
    "kpi_card", "monthly_timeline", "infraction_distribution", "zone_caseload", "product_register", "violation_registry",
    "transcript_lines", "label_compliance_overview", "line_classes", "declaration_classes", "category_letters", "gated_categories", "net_quantity", "retail_price", "price_detection",
    "label_entities", "canonical_fields", "text_sections", "reading_order", "words_to_lines", "rule_evaluations", "violation_summary", "final_results",
    "statutory_checks", "compliance_scores", "unified_fields", "session_matches", "product_clusters", "entity_links", "state_transitions", "semantic_fields",
]


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "tallymark.spread": cpus})
    spark.sparkContext.setLogLevel("OFF")
    catalogue = load_catalogue()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        catalogue[name].build(spark, data_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(data_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
