"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line.

Each query runs twice over its whole tables; the second time is reported, because the first
includes JVM and code-generation start-up. ``first_run`` keeps the cold times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from setspan.plans import registry  # noqa: E402
from setspan.plans.tables import part_values  # noqa: E402
from setspan.session import build_session  # noqa: E402

HEADLINE = [
    "ora_by_year",
    "ora_by_direction",
    "ora_gene_lists",
    "ora_tokens_toxic",
    "rank_genes",
    "enrichment_score",
    "leading_edge",
    "gsea_hash_null",
    "gsea_vector_null",
    "gsea_adaptive",
    "bh_adjust",
    "hypergeom_tail",
    "idmap_two_hop",
    "idmap_layers",
    "conversion_report",
    "apply_conversion",
    "merge_collections",
    "audit_contract",
    "concordance",
    "diagnose_gsea",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    first, best = {}, {}
    for name in HEADLINE:
        for times in (first, best):
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    contrasts = part_values(spark, sf_dir).select("contrast").distinct().count()
    scaling = {}
    for partitions in (cpus, str(4 * int(cpus))):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        start = time.time()
        registry.QUERIES["ora_by_year"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        scaling[partitions] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "seconds_per_contrast": {
                    q: round(best[q] / contrasts, 3) for q in ("ora_by_year", "gsea_vector_null", "gsea_adaptive")
                },
                "contrasts": contrasts,
                "ora_by_year_by_partitions": scaling,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
