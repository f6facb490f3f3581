"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set input and cores.
Each query is written to the noop sink, so every output column is computed. The chain
dataset that the later queries read is built first and timed as ``build_shards``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stagecraft.catalog import fixtures  # noqa: E402
from stagecraft.catalog.queries import QUERIES  # noqa: E402

HEADLINE = (
    "build_chains", "build_or_reuse", "ingest_stream", "edge_pairs", "flip_findings",
    "cap_per_split", "block_shuffle", "citation_labels", "build_pools", "bm25_scores",
    "dense_scores", "encode", "perplexity", "edge_loss", "mean_pairwise_cos",
    "effective_rank", "spearman", "auroc", "significance_report", "evaluate_all",
    "training_losses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}

    def lap(name: str, start: float) -> None:
        times[name] = round(time.perf_counter() - start, 3)

    start = time.perf_counter()
    fixtures.shards(spark, sf_dir)
    lap("build_shards", start)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        lap(name, start)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
