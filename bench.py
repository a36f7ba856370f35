"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the cores of local[n]. Each query runs once to warm up and then once
timed, into the noop sink, so every row is computed and none is kept. ``planning`` is the part of a query's time that
goes by before its first task: the dialect, and Catalyst up to the physical plan.
"""

import json
import os
import time

from quern.plans import suite
from quern.session import local_session

HEADLINE = (
    "tpch_q1", "tpch_q3", "tpch_q5", "tpch_q6", "tpch_q9", "tpch_q10", "tpch_q13", "tpch_q14", "tpch_q15", "tpch_q17",
    "tpch_q18", "tpch_q19", "tpch_q22", "j1_inner_keys", "q12_correlated_scalar", "a7_distinct_mixed", "a14_cube",
    "w3_w8_rows", "o10_top_k", "u3_intersect", "f13_regexp_replace", "r17_affine_sums", "r18_narrow_keys",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": cores})
    found = suite.queries()
    times, planning = {}, {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            df = found[name](spark, sf_dir)
            df._jdf.queryExecution().executedPlan()
            planned = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
            planning[name] = round(planned - started, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of the headline queries", "value": total, "unit": "sec", "queries": times, "planning": planning, "sf": sf}))


if __name__ == "__main__":
    main()
