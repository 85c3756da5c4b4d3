"""Benchmark: run the named queries at one scale and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list; default: all registered queries).
Each query is forced with the no-op sink (full evaluation, no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["shortest_paths", "pagerank_static", "triangle_count"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from edgewise import queries
    from edgewise.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, driver_memory="16g",
                          app="edgewise-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(queries.QUERIES)
    # warm the JVM (class loading, code generation) on a scan and one short
    # loop, so the first timed query does not carry start-up cost
    queries.QUERIES["out_degrees"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    from edgewise.plans import fixtures as fx
    (fx.part_next(spark, sf_dir).page_rank(max_iter=1).vertices
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            df = queries.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as ex:  # keep going; report
            errors[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
        print(f"# {name}: {times.get(name, 'ERROR')}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline": {k: times.get(k) for k in HEADLINE},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
