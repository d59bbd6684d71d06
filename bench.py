"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once cold and once warm to the noop sink; `queries` has the warm seconds, `cold` the first ones.
`questions_per_second` is that of the batch of hybrid_search, the figure nearest to the published retrieval stages.
"""

import importlib.util
import json
import os
import sys
import time

from quillspark.plans.catalog import QUERIES
from quillspark.session import build, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ("tokenize", "bm25_topk", "dense_topk", "rrf_fusion", "hybrid_search", "split_structure", "rerank", "fenced_context", "pack_greedy", "detect_references")
CORPUS = ("op8_near_dedup", "op10_bpe_round_trip")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = {k: QUERIES[k] for k in HEADLINE}
    if importlib.util.find_spec("quillspark.llm"):
        from quillspark.llm.queries import QUERIES as MORE

        todo |= {k: MORE[k] for k in CORPUS}
    cold, warm = {}, {}
    for name, run in todo.items():
        for seconds in (cold, warm):
            began = time.time()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    asked = table(spark, SF_DIR, "benchmark").count()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "questions_per_second": round(asked / warm["hybrid_search"], 2), "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
