"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from apsidal.plans import cascade, catalog, manoeuvres, objects, scores, space, statistics  # noqa: F401 (each registers its queries)

HEADLINE = ["screening", "alert_scores", "hit_probability", "debris_exposure", "top_alerts", "alert_merge", "worsened_secondaries", "residual_scores", "settled_predictions", "distance_minima", "cloud_statistics", "cascade_depth", "disk_integral", "decisions_of_alerts", "agency_resolution", "hotspots", "correlation_pairs", "fragment_screening", "engine_choices", "burn_choice", "burn_corridors"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["owner_lookup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else None}))
    spark.stop()


if __name__ == "__main__":
    main()
