"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from lodestat.operators import association, drift, explore, metrics, noise, prepare, profiling, scoring
from lodestat.plans.catalog_models import _THEMES, _terms
from lodestat.plans.registry import holes, scored, sides, table
from lodestat.session import new_session
from lodestat.streaming import alerts


def headline(spark, folder):
    """Name → DataFrame builder, over whole tables."""
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    documents = table(spark, folder, "documents")
    numbers, nominals = ["q", "p", "d", "t"], ["f", "s", "g"]
    return {
        "profile_all_columns": lambda: profiling.profile_columns(orders),
        "infer_types_lineitem": lambda: profiling.infer_semantic_types(
            items, ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        ),
        "normalize_text": lambda: prepare.conform(documents.select("lang", "text"), {}),
        "dedup_exact": lambda: prepare.dedup_exact(items),
        "numeric_overview": lambda: explore.numeric_overview(holes(spark, folder), numbers),
        "iqr_outliers": lambda: explore.iqr_outliers(holes(spark, folder), numbers),
        "cramers_v_matrix": lambda: association.cramers_v_matrix(holes(spark, folder), nominals),
        "association_matrix": lambda: association.association_matrix(
            holes(spark, folder), ["q", "d", "t"], nominals
        ),
        "cramers_v_noise_500": lambda: noise.cramers_v_noise(holes(spark, folder), "f", "g"),
        "classification_metrics": lambda: metrics.classification_metrics(
            scored(spark, folder), "y", "p"
        ),
        "threshold_table": lambda: metrics.threshold_table(scored(spark, folder), "y", "p"),
        "assess_drift": lambda: drift.assess_drift(
            *sides(spark, folder), ["o_totalprice", "o_custkey"], ["o_orderpriority", "o_orderstatus"]
        ),
        "correlation_ratio_noise_500": lambda: noise.correlation_ratio_noise(
            holes(spark, folder), "p", "g"
        ),
        "fairness_audit": lambda: metrics.fairness_audit(
            scored(spark, folder), "y", "p", 0.5, ["o_orderpriority"]
        ),
        "dedup_documents": lambda: prepare.dedup_exact(documents.drop("doc_id")),
        "error_rate_window": lambda: alerts.error_rate_window(
            table(spark, folder, "events"), "ts", F.col("event_type") == "error", 0.1
        ),
        "score_and_top6": lambda: scoring.top_contributions(items, _terms(), -0.2, _THEMES),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = new_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "1m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times = {}
    for name, build in headline(spark, folder).items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
