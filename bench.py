"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from floeframe.plans.catalogue import QUERIES  # noqa: E402
from floeframe.session import local_session  # noqa: E402

HEADLINE = ["persistence_skill", "valid_rows", "product_compare", "regrid_mean", "stratified_sample", "steps", "wind_bilinear",
            "drift_error", "calibration_grid", "radius_q90", "exposure", "rio_interval", "dominant_polygon", "composed_cost",
            "bucket_source", "route_price", "route_divergence", "route_groups", "mission_summary", "edges", "least_cost", "gbt_skill"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    names = sys.argv[1:] or HEADLINE
    QUERIES["persistence_skill"](spark, sf_dir).write.format("noop").mode("overwrite").save()    # warm-up
    took = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
