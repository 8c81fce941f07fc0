"""Time the headline work at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line.  ``ingest_*`` entries start from NDJSON text and end in stored bronze
tables; all other entries read stored tables, as a board does.  Each query runs once to warm
up and then ``$BENCH_RUNS`` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from telemill import contract as C  # noqa: E402
from telemill.functions import verdicts as V  # noqa: E402
from telemill.operators import edges as E, silver as SV, traces as TR, validation as VA  # noqa: E402
from telemill.plans import boards as B, delivery as D, rollups as R, views as VW  # noqa: E402
from telemill.session import build_session  # noqa: E402
from telemill.sources import bridge, ndjson, scrapes, tables as TB  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    times, facts = run(spark, root)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR),
                      "facts": facts}))


def run(spark, root: str) -> tuple[dict[str, float], dict]:
    times: dict[str, float] = {}
    facts: dict = {}
    begun = time.perf_counter()

    def clock(name: str, action, warm: bool = True) -> float:
        if warm:
            action()
        best = min(_timed(action) for _ in range(RUNS if warm else 1))
        times[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
        return best

    def noop(build):
        return lambda: build().write.format("noop").mode("overwrite").save()

    # The events file is one row group; spread it so that all cores take part.
    source = f"{root}/source"
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(int(CPUS)).write.parquet(
        f"{source}/events.parquet")
    lines = f"{root}/lines"
    bridge.signal_lines(spark, source).select("value").write.text(lines)
    for table, rows in bridge.bronze(spark, source).items():
        TB.write_piece(rows, root, table, "all")
    bronze = TB.read_bronze(spark, root)
    for table, rows in SV.to_silver(bronze).items():
        TB.write_piece(rows, root, table, "all")
    silver = TB.read_silver(spark, root)
    for table, rows in R.all_rollups(silver).items():
        TB.write_piece(rows, root, table, "all")
    rolled = {t: TB.read_table(spark, root, t) for t in C.ROLLUP_TABLES}
    samples = TB.stage(scrapes.read_scrapes(bridge.scrape_lines(spark, source)), root, "samples")
    as_of = bridge.read_events(spark, SF_DIR).agg(F.max("ts")).first()[0]
    ops, logs, mets = (silver[t] for t in C.SILVER_TABLES)
    print(f"tables ready {time.perf_counter() - begun:.1f}", file=sys.stderr, flush=True)
    facts["bronze_rows"] = sum(df.count() for df in bronze.values())

    def ingest():
        signals = VA.validate(ndjson.read_signals_ndjson(spark, lines))
        TB.write_bronze(VA.apply_policy(signals, "warn"), f"{root}/ingest", "all")

    signals = spark.read.text(lines).count()
    took = clock("ingest_ndjson_to_bronze", ingest)
    facts["ingest_signals_per_s"] = round(signals / took)
    clock("validate", noop(lambda: VA.reject_matrix(VA.validate(
        ndjson.read_signals_ndjson(spark, lines)))))
    clock("table_counts", noop(lambda: B.table_counts(bronze)))
    clock("lineage", noop(lambda: B.lineage(bronze)))
    clock("contract_violations", noop(lambda: B.contract_violations(bronze)))
    clock("volume_band_60min", noop(lambda: V.volume_state(B.volume_band(
        B.volume_buckets(bronze["otel_logs"], as_of, 60)))))
    clock("volume_band_all_hours", noop(lambda: V.volume_state(B.volume_band(
        B.volume_buckets(bronze["otel_logs"], as_of, None, "hour")))))
    clock("call_edges", noop(lambda: E.call_edges(bronze["otel_traces"])))
    clock("call_edges_1m", noop(lambda: E.call_edges_1m(ops)))
    clock("service_health_1m", noop(lambda: VW.service_health_1m(ops)))
    clock("log_health_1m", noop(lambda: VW.log_health_1m(logs)))
    clock("trace_summary", noop(lambda: VW.trace_summary(ops)))
    clock("telemetry_coverage_1m", noop(lambda: VW.telemetry_coverage_1m(silver)))
    clock("run_summary", noop(lambda: VW.run_summary(silver)))
    clock("metric_stats_1m", noop(lambda: R.metric_stats_1m(mets)))
    clock("metric_rollup_merged", noop(lambda: R.metric_rollup_merged(
        rolled["metric_stats_1m"])))
    clock("volume_1m", noop(lambda: R.volume_1m(silver)))
    clock("resource_key_presence_1m", noop(lambda: R.resource_key_presence_1m(silver)))
    clock("rows_missing_key", noop(lambda: R.rows_missing_key(
        rolled["resource_key_presence_1m"])))
    clock("logs_with_trace", noop(lambda: TR.logs_with_trace(logs, ops)))
    clock("tick_table", noop(lambda: D.tick_table(samples)))
    ticks = TB.stage(D.tick_table(samples), root, "ticks")
    clock("delivery_verdict", noop(lambda: D.delivery_verdict(D.delivery_mode(
        D.tick_metrics(ticks)))))
    return times, facts


def _timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


if __name__ == "__main__":
    main()
