"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and fully executed into the no-op sink (no collect), timed
end to end; one warm-up query runs first so JVM start-up is not charged to a query.
Each query runs BENCH_REPEAT (default 2) times and the faster run counts: the first run
of a new plan shape also pays for compiling its generated code, which is a fixed cost
that does not grow with the data. First-run times are reported too. Memoised inputs
(numbered candidates) are dropped before every run; the corpus index is built once and
timed as ``index_build``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankloom.plans import registry  # noqa: E402
from rankloom.session import local_session  # noqa: E402
from rankloom.sources import tables  # noqa: E402

HEADLINE = ["index_build", "bm25_topk", "hybrid_topk", "retrieve_pipeline", "recommend_batch", "eval_summary",
            "vector_topk", "hard_filter", "apply_rankings", "page_records", "merge_catalog",
            "crawl_cutoff", "diverse_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16,
                          app="rankloom-bench")
    registry.QUERIES["token_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    first, best = {}, {}
    for name in names:
        runs = []
        for _ in range(1 if name == "index_build" else repeat):
            tables._NUMBERED.clear()          # every run redoes its own input preparation
            t0 = time.perf_counter()
            if name == "index_build":
                # the document index and the catalog, written once per corpus and
                # reused by the query entries below (as an engine loads its index at start)
                registry._doc_search(spark, sf_dir)
                tables.document_catalog(spark, sf_dir)
            else:
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        first[name], best[name] = runs[0], min(runs)
        print(f"{name}: {runs}s", file=sys.stderr)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": f"headline_queries_total_best_of_{repeat}", "value": round(sum(best.values()), 3),
                      "unit": "sec", "queries": best, "first_run": first,
                      "first_run_total": round(sum(first.values()), 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
