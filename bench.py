"""Times the headline queries, and the published key-value workload set-at-a-time; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the local cores. Each query runs once to warm up and then BENCH_RUNS
times, of which the median counts. Every result is consumed whole by a no-op sink.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
HEADLINE = ["live_view", "latest_any", "multi_get", "missing_keys", "upsert_orders", "kway_merge", "bottom_gc", "sorted_run_scan", "sparse_floor_lookup", "bloom_probe", "level_overlap", "log_valid_prefix"]
PUTS, GETS, BATCH = 1_000_000, 100_000, 1000


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lamina import queries
    from lamina.operators import read
    from lamina.schema import Options
    from lamina.store import Store

    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(f, times: int = runs) -> float:
        f()
        out = []
        for _ in range(times):
            began = time.time()
            f()
            out.append(time.time() - began)
        return round(median(out), 3)

    consume = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds = {name: timed(lambda name=name: consume(queries.QUERIES[name](spark, sf))) for name in HEADLINE}

    # the workload of the published figures: ordered puts, puts of random keys, gets, gets of missing keys
    folder = tempfile.mkdtemp()
    key = lambda column: F.concat(F.lit("key-"), F.lpad(column.cast("string"), 8, "0"))
    value = F.concat(F.lit("val-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("value")
    ordered = spark.range(PUTS).select(key(F.col("id")).alias("key"), value)
    random = spark.range(PUTS).select(key(F.pmod(F.xxhash64("id"), F.lit(PUTS))).alias("key"), value)
    n = iter(range(1000))

    def write(rows):
        """Put a million rows as one batch with the default flush: the runs are written in the same time."""
        store = Store(spark, f"{folder}/{next(n)}", Options())
        store.put_batch(rows)
        return store

    def small(times: int):
        """Puts of BATCH rows at a time, each a durable batch of the log, flushed at 4 MiB as the published workload is."""
        store = Store(spark, f"{folder}/{next(n)}", Options())
        for i in range(times):
            store.put_batch([(f"key-{j:08d}", f"val-{j:08d}") for j in range(i * BATCH, (i + 1) * BATCH)])

    seconds["put_ordered_1m_with_flush"] = timed(lambda: write(ordered))
    seconds["put_random_1m_with_flush"] = timed(lambda: write(random))
    seconds["put_20_batches_of_1000"] = timed(lambda: small(20), 1)
    store = write(ordered)
    store.put_batch(random)
    wanted = spark.range(GETS).select(key(F.pmod(F.xxhash64("id"), F.lit(PUTS))).alias("key"))
    absent = spark.range(GETS).select(F.concat(F.lit("none-"), F.col("id").cast("string")).alias("key"))
    seconds["get_100k"] = timed(lambda: consume(store.multi_get(wanted)))
    seconds["get_missing_100k"] = timed(lambda: consume(read.missing(store.mutations(), absent)))
    shutil.rmtree(folder, ignore_errors=True)
    rate = {k: round(m / seconds[k]) for k, m in (("put_ordered_1m_with_flush", PUTS), ("put_random_1m_with_flush", PUTS), ("put_20_batches_of_1000", 20 * BATCH), ("get_100k", GETS), ("get_missing_100k", GETS))}
    print(json.dumps({"metric": "headline queries and the key-value workload, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "ops_per_sec": rate}))


if __name__ == "__main__":
    main()
