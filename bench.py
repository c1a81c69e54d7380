"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  table directory (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_REPEAT  timed runs per query after one warm-up; the fastest counts (default 2)

``queries`` holds seconds per query.  ``events_per_second`` and
``us_per_event_core`` give the clustering throughput of whole jobs (scan,
event assembly, clustering, jets), the quantity to set against per-event times.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jetlake.operators import clustering  # noqa: E402
from jetlake.plans import catalog, pipelines  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))

HEADLINE = ["antikt_inclusive", "ca_inclusive", "kt_inclusive", "eekt_inclusive", "durham_exclusive",
            "history_rows", "param_scan", "filter", "trim", "mass_drop", "soft_drop",
            "hepmc_round_trip", "multiplicity", "event_window", "trial_stats", "trial_outliers",
            "trial_histogram", "scan_merge", "scan_speedup", "ratio_means", "figure_series"]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def fastest(make):
    run(make())
    times = []
    for _ in range(REPEAT):
        start = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - start)
    return min(times)


def clustering_rate(spark, event, copies, **options):
    """Clustering alone over prepared event rows, repeated to outweigh the start of a job."""
    events = pipelines.event_rows(spark, SF_DIR, event).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(CPUS).persist()
    n, mean = events.agg(F.count("*"), F.avg(F.size("particles"))).first()
    took = fastest(lambda: clustering.inclusive_jets(events, **options))
    events.unpersist()
    return {"events": n, "mean_particles": round(mean, 1), "seconds": round(took, 3),
            "events_per_second": round(n / took, 1), "us_per_event": round(took / n * 1e6, 1),
            "us_per_event_core": round(took / n * CPUS * 1e6, 1)}


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(fastest(lambda: catalog.QUERIES[name](spark, SF_DIR)), 3) for name in HEADLINE}
    rates = {
        "antikt_low": clustering_rate(spark, "l_partkey", 10, algorithm="AntiKt", R=0.4),
        "durham_low": clustering_rate(spark, "l_partkey", 10, algorithm="Durham", R=4.0),
        "antikt_high": clustering_rate(spark, "l_suppkey", 4, algorithm="AntiKt", R=0.4),
    }
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "clustering": rates, "cpus": CPUS,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
