"""Run the headline queries once each and print one JSON line.

Every query starts without stored sketches, except those listed as reading a store: the join reports work on
the sketches that an earlier run has left behind.
"""

from __future__ import annotations

import json
import os
import time

from lakeweave.plans import showcase
from lakeweave.session import local_session

# What is measured, in this order.
COLD = ["joinable_columns", "fast_joinable_columns"]
FROM_STORE = ["dataset_edges", "top_dataset_pairs", "containment_histogram"]
OTHERS = [
    "column_profile",
    "cosine_pairs",
    "column_text",
    "alike_by_embedding",
    "domain_rollup",
    "sparseness_buckets",
    "publication_age",
    "headline_counts",
    "value_histogram",
    "city_report",
    "page_titles",
    "profiled_catalog",
    "streamed_sketches",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def run(name: str, label: str) -> None:
        start = time.perf_counter()
        # A full write to nowhere: a count would let the optimizer drop the columns.
        rows = showcase.QUERIES[name](spark, directory)
        rows.write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - start, 3)

    showcase.table(spark, directory, "lineitem").groupBy("l_returnflag").count().collect()
    for name in COLD:
        showcase.forget_sketches()
        run(name, name)
    showcase.forget_sketches()
    run("register_cardinality", "sketch_build")
    for name in FROM_STORE:
        run(name, f"{name}_from_store")
    for name in OTHERS:
        run(name, name)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
