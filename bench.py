"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "kf_filter",
    "kf_final",
    "kf_constant_velocity",
    "rts_smoother",
    "ekf_filter",
    "ukf_filter",
    "series_kalman_filter",
    "series_unscented_smoother",
    "energy_grid",
    "weighted_moments",
    "resample_systematic",
    "particle_frame_filter_series",
    "transition_mixture",
    "particle_bootstrap",
    "particle_sir_unscented",
    "trajectories_backward",
)


def workloads(spark: SparkSession) -> dict[str, tuple[int, object]]:
    """The reference's own workloads, eight series of each: particles x steps moved, and what runs them."""
    from tidestate import models
    from tidestate.operators import estimation
    from tidestate.plans import folds, series
    from tidestate.sources import simulate
    from pyspark.sql import functions as F

    def particles(name: str, steps: int, method: str, n: int):
        obs = simulate.simulate(spark, name, 8, steps).select("series_id", "t", "ys").cache()
        obs.count()
        return 8 * steps * n, lambda: series.particle_filter(obs, models.EXAMPLES[name](), method, n)

    def chain(ys, rng):
        return estimation.noise_chain(models.cube_root(), ys, 200, rng, n=100)

    def kalman(steps: int):
        rows = spark.range(8).select(F.col("id").alias("series_id"), F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: (i % 97).cast("double")).alias("ys")).cache()
        rows.count()
        return 8 * steps, lambda: folds.scan(rows, {"m": 0.0, "p": 1.0, "ll": 0.0}, folds.kalman_1d())

    cube = simulate.simulate(spark, "cube_root", 8, 150).select("series_id", "t", "ys").cache()
    cube.count()
    return {
        "bootstrap_cube_root_1000x150": particles("cube_root", 150, "bootstrap", 1000),
        "sir_unscented_cube_root_1000x150": particles("cube_root", 150, "sir_unscented", 1000),
        "bootstrap_volatility_1000x200": particles("stochastic_volatility", 200, "bootstrap", 1000),
        "bootstrap_lorenz_1000x50": particles("lorenz", 50, "bootstrap", 1000),
        "auxiliary_pendulum_100x500": particles("pendulum", 500, "auxiliary", 100),
        "pmmh_cube_root_200x100x150": (8 * 201 * 100 * 150, lambda: series.chains(cube, chain)),
        "kalman_fold_1000_steps": kalman(1_000),
        "kalman_fold_10000_steps": kalman(10_000),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidestate import queries

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run also compiles code and starts workers
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    rates, seconds = {}, {}
    for name, (moved, run) in workloads(spark).items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        rates[name] = round(moved / seconds[name])
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "median": round(statistics.median(took.values()), 3), "event_rows": rows, "workload_seconds": seconds, "workload_steps_per_second": rates, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
