"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2:
the first run of each query warms up, the best of the others counts), BENCH_SCALING (default
"1,4": further core counts at which the queries of SCALING run, each in a session of its own;
empty for none). ``rates`` are input rows a second; ``index`` times a build and a read.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "topk_l2", "topk_sparse_cosine", "prompt_numbered", "tfidf", "kmeans_topics", "extractive_summary",
    "mindmap", "hash_embed", "nested_declarations", "extract_calls", "all_relations", "class_diagram",
    "load_or_create_index", "code_search",
]
SCALING = ["topk_l2", "tfidf", "hash_embed"]
# The table whose rows a rate counts.
INPUT = {
    "topk_l2": "embeddings", "topk_sparse_cosine": "documents", "tfidf": "documents", "hash_embed": "documents",
    "kmeans_topics": "documents", "nested_declarations": "orders", "class_diagram": "orders",
}


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark, folder: str, names: list[str], runs: int) -> dict[str, float]:
    from codequarry.plans.queries import QUERIES

    times = {}
    for name in names:
        taken = []
        for _ in range(max(1, runs)):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken[1:] or taken), 3)
        print(f"{name}: {[round(t, 2) for t in taken]}", file=sys.stderr, flush=True)
    return times


def index_times(spark, folder: str) -> dict[str, float]:
    from codequarry.plans import queries
    from codequarry.sources import storage

    root, out = storage.new_folder(spark, "bench-index"), {}
    for state in ("cold", "warm"):
        start = time.perf_counter()
        queries._code_index(spark, folder, root).write.format("noop").mode("overwrite").save()
        out[state] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    if len(sys.argv) > 1 and sys.argv[1] == "--only":
        print(json.dumps(timed(session(cpus), folder, SCALING, 2)))
        return
    spark = session(cpus)
    times = timed(spark, folder, HEADLINE, runs)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in set(INPUT.values())}
    index = index_times(spark, folder)
    spark.stop()
    scaling = {cpus: {n: times[n] for n in SCALING}}
    for n in filter(None, os.environ.get("BENCH_SCALING", "1,4").split(",")):
        done = subprocess.run(
            [sys.executable, __file__, "--only"], env=os.environ | {"BENCH_CPUS": n}, capture_output=True, text=True
        )
        if done.returncode == 0:
            scaling[n] = json.loads(done.stdout.strip().splitlines()[-1])
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "rates": {n: round(rows[t] / times[n], 1) for n, t in INPUT.items()}, "index": index, "scaling": scaling,
    }))


if __name__ == "__main__":
    main()
