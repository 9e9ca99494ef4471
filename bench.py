"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into the ``noop`` sink (no collect), after a
warm-up of the JVM, the Python worker pool and the embedder's code paths on
synthetic input (none of the benchmark tables is touched).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tmweave.functions.vectors import hash_embedding  # noqa: E402
from tmweave.plans.queries import QUERIES  # noqa: E402
from tmweave.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", app="tmweave-bench",
                          shuffle_partitions=max(8, cpus * 2),
                          **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up: JVM code paths and the Python worker pool (one pandas function).
    QUERIES["decode_object_keys"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    (spark.range(0, 64, numPartitions=cpus)
     .mapInPandas(lambda it: (b for b in it), "id long")
     .write.format("noop").mode("overwrite").save())
    # ...and the JIT for the embedder's lambda evaluation, on synthetic strings.
    (spark.range(0, 20000, numPartitions=cpus)
     .select(hash_embedding(F.concat(F.lit("warm up text "), F.col("id").cast("string")))
             .alias("e"))
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - reported in the JSON line
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
    spark.stop()
    sf = os.path.basename(sf_dir).removeprefix("sf")
    out = {"metric": "total_query_seconds",
           "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
