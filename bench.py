"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from gridlens import catalog
from gridlens.session import build_session

HEADLINE = [
    "naive_weekly_score",
    "add_lags_and_rolling",
    "clean_clients",
    "join_weather",
    "rolling_mean_past",
    "resample_mean_ffill",
    "hourly_profile_matrix",
    "jenks_breaks",
    "cluster_series",
    "cluster_ols_fit",
    "error_box_stats",
    "acf",
    "client_profiles",
    "mirror_future",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("gridlens-bench", cpus, os.environ.get("BENCH_MEMORY", "12g"))
    queries = catalog.queries()
    # One small untimed run starts the JVM's and Python's workers.
    queries["client_profiles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
