"""Times the headline work at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession, functions as F

    scratch = tempfile.mkdtemp(prefix="bench-")  # one machine: driver and executors share it
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("mendcast-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{scratch}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from mendcast.layout import materialise
    from mendcast.operators import repair as rp, score as sc
    from mendcast.operators.compare import extended_leaderboard, pairwise_ttest, stats_by_model
    from mendcast.operators.cost import tradeoff_ranking
    from mendcast.operators.encode import encode_gaf
    from mendcast.operators.forecast import FORECASTERS, forecast, forecast_sources
    from mendcast.operators.mask import degrade
    from queries.fixtures import cost_rows, grid_for, li_day, pred_results, table
    from mendcast.sources.series_io import series_from_table

    times: dict[str, float] = {}
    state: dict = {}

    def timed(name):
        def run(fn):
            start = time.time()
            state[name] = fn()
            times[name] = round(time.time() - start, 3)
        return run

    table(spark, sf, "events").count()  # start the JVM's readers before the clock

    @timed("ingest_series")
    def _():
        out = materialise(series_from_table(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value"))
        return out, out.count()

    points, n_points = state["ingest_series"]

    @timed("mask_grid")
    def _():
        grid = grid_for(points, ("MCAR", "MAR", "MNAR"), (0.1, 0.3), 2)
        out = materialise(degrade(points, grid, keep_truth=True).withColumn("masked", F.col("value").isNull()))
        return out, out.count()

    degraded, n_degraded = state["mask_grid"]

    @timed("repair_all_methods")
    def _():
        gaps = materialise(rp.reconstruct_gaps(degraded, list(rp.METHODS)))  # observed points stay stored once
        out = rp.with_observed(gaps, degraded, list(rp.METHODS))
        return out, out.count()

    repaired, n_repaired = state["repair_all_methods"]

    @timed("score_repairs")
    def _():
        out = materialise(sc.score_reconstruction(sc.pairs_from_truth(repaired)))
        return out, out.count()

    results, n_results = state["score_repairs"]
    timed("leaderboard")(lambda: stats_by_model(results, "rmse", True).collect())
    timed("significance")(lambda: pairwise_ttest(results, "rmse").collect())
    timed("forecast_all_models")(lambda: forecast(forecast_sources(points, None), list(FORECASTERS), 30).agg(
        F.count("predicted"), F.sum("predicted")).collect())
    timed("forecast_daily_revenue")(lambda: forecast(li_day(spark, sf), list(FORECASTERS), 30).agg(F.sum("predicted")).collect())
    timed("extended_leaderboard")(lambda: extended_leaderboard(pred_results(spark, sf), "mape", True).collect())
    timed("tradeoff_ranking")(lambda: tradeoff_ranking(cost_rows(spark, sf), None, True).collect())
    timed("encode_gaf_64")(lambda: encode_gaf(points, 64).agg(F.sum("v")).collect())

    configs = n_results
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rsplit("sf", 1)[-1],
        "points": n_points, "degraded_points": n_degraded, "repaired_points": n_repaired,
        "degradations_per_sec": round(points.select("series_id").distinct().count() * 12 / times["mask_grid"], 1),
        "reconstructions_per_sec": round(configs / times["repair_all_methods"], 1),
        "repaired_points_per_sec": round(n_repaired / times["repair_all_methods"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
