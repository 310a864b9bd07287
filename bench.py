"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from belegwerk.plans import catalog  # noqa: E402
from belegwerk.session import local_session  # noqa: E402

HEADLINE = (
    "invoice_amounts", "line_net_amounts", "vat_breakdown", "total_warnings", "line_positions", "canonical_text",
    "evidence_rejected", "number_format", "shared_address_losers", "evidence_claims_rejected", "normalize_decimal",
    "normalize_facts_accepted", "missing_facts", "rule_findings", "audit_chain", "audit_decisions", "daily_spend",
    "budget_admission", "rate_limit", "compared_facts", "term_accuracy", "evaluation_summary",
    "issues", "invoice_xml",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    # One run warms the JVM; it is not counted.
    catalog.run("invoice_totals", spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
