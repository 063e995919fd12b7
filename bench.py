"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once cold and $BENCH_RUNS times (5) warm; its figure is the warm median. Beside it
stand the cold time and the bytes that the last warm run shuffled.
"""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = ["all_measures", "coh", "coh_multitaper", "coh_embeddings", "psi_bands", "coh_time", "time_smoothed_hanning", "envcorr_pairwise", "wsmi_k3", "var1_dynamic", "var_p_dynamic", "select_order_criteria", "mim_2x2", "cacoh_multi", "gc", "surrogate_pvalue", "conn_degree", "symmetric_orth"]


def shuffled(spark: SparkSession) -> int:
    """Bytes written to shuffles by all stages so far; what the listeners are still told of is waited for."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    from covaria.queries import QUERIES

    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map={"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.ui.retainedStages": "100000"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm, moved = {}, {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            before = shuffled(spark)
            began = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            moved[name] = shuffled(spark) - before
        cold[name], warm[name] = round(times[0], 3), round(median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": f"headline queries, warm, median of {RUNS}", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "shuffle_bytes": moved, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
