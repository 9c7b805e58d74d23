"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spantail.plans import catalog

HEADLINE = ["forwarded_spans", "forwarded_spans_window", "drop_rate", "span_cap_hides_error", "sampler_counters", "replay_episodes", "replay_decision_wait", "otlp_roundtrip", "store_attr_lookup", "store_time_range", "metric_rate_5m"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(run) -> float:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        return round(median(took[1:]), 4)

    def whole(name: str):
        return lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    out = {name: seconds(whole(name)) for name in HEADLINE}
    lines = catalog.lineitem_spans(spark, sf_dir).select(*catalog.SPAN).cache()
    n = lines.count()
    from spantail.operators import sampling

    bulk = seconds(lambda: sampling.forwarded_window(lines, catalog.policies()).agg(F.count("*")).collect())
    rate = sampling.drop_rate(lines, catalog.policies()).first().dropped_percent
    store = catalog.events_store(spark, sf_dir)
    absent = seconds(lambda: store.where_attr("k", "absent").count())
    plain = seconds(lambda: store.read().where(F.try_element_at("attributes", F.lit("k")) == "absent").count())
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")), "spans": n, "spans_per_sec": round(n / bulk), "traces_per_sec": round(lines.select("trace_id").distinct().count() / bulk), "dropped_percent": rate, "lookup_absent_sec": absent, "scan_absent_sec": plain}))


if __name__ == "__main__":
    main()
