"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores.  Stage results that several operators read (the fact table, candidates, section
versions) are written once per session; each is timed as an entry of its own, so a query
below never includes or hides the cost of another stage.
"""

from __future__ import annotations

import json
import os
import time

from concordat.plans import catalogue as C
from concordat.session import build_session

STAGES = [
    ("stage_fact_table", lambda s, d: C.fact_table(s, d)),
    ("stage_candidates", lambda s, d: C.candidates(s, d)),
    ("stage_versions_run1", lambda s, d: C.versions(s, d, 1)),
    ("stage_versions_run2", lambda s, d: C.versions(s, d, 2)),
    ("stage_claims_run2", lambda s, d: C.claims_of(s, d, 2)),
    ("stage_citations_run2", lambda s, d: C.citations_of(s, d, 2)),
    ("stage_batches", lambda s, d: C._batches(s, d)),
    ("stage_judged", lambda s, d: C._judged(s, d)),
    ("stage_violations_run1", lambda s, d: C._violations(s, d, 1)),
    ("stage_violations_run2", lambda s, d: C._violations(s, d, 2)),
    ("stage_published", lambda s, d: C._published(s, d)),
]
QUERIES = [
    "b2_dedupe_documents", "b3_chunk_documents", "b3_chunk_articles", "c1_enrich_cached", "c2_parse_classifications",
    "c7_parse_extractions", "c9_resolve_citations", "c11_normalize_facts", "d1_fact_views", "d3_display_names",
    "d4_reconcile", "d5_governing_at", "d6_supersession", "e1_equal_rank", "e2_temporal_violations",
    "e3_arithmetic_mismatches", "e6_with_direction", "f2_check_explanations", "g1_section_plans",
    "g2_plan_recomposition", "g4_citations", "h2_evaluate_rules", "i1_verify_run", "j1_build_changes",
    "j2_change_causes", "k1_assemble_findings", "k3_prior_verdicts", "l2_provenance", "l4_stage_costs",
    "m1_render_sections", "m3_reconcile_published", "n1_diff_snapshot", "n3_maintained_states",
    "n3_maintained_candidates",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's machinery

    seconds: dict[str, float] = {}
    for name, stage in STAGES:
        start = time.perf_counter()
        stage(spark, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in QUERIES:
        start = time.perf_counter()
        C.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    counts = C.QUERIES["g5_plan_summary"](spark, folder).first().asDict()
    untouched = C.QUERIES["j3_change_summary"](spark, folder).first()["untouched_fraction"]
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "delta_run": {**counts, "untouched_fraction": untouched},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
