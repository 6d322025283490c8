"""DataFrame operators: nulls, single rows, CSV, streams."""

import numpy as np
from pyspark.sql import functions as F

from tidestate import models
from tidestate.plans import folds, particle_frames as pf, series
from tidestate.sources import simulate, tables
from tidestate.streaming import online

ROWS = [(1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (2, 1, None), (3, 9, 1.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k long, at int, v double")


def test_missing_values_predict_only(spark):
    s = folds.series(frame(spark), "k", ["at"], "v")
    native = folds.scan(s, {"m": 0.0, "p": 1.0, "ll": 0.0}, folds.kalman_1d()).toPandas().sort_values(["series_id", "t"])
    obs = series.observations(frame(spark), "k", ["at"], "v")
    other = series.gaussian_filter(obs, models.random_walk()).toPandas().sort_values(["series_id", "t"])
    assert np.allclose(native["m"], other["mean"].str[0]) and len(native) == len(ROWS)
    assert np.allclose(native.groupby("series_id")["ll"].last(), other.groupby("series_id")["loglik"].sum())
    sm = folds.smooth_1d(folds.scan(s, {"m": 0.0, "p": 1.0, "ll": 0.0}, folds.kalman_1d()), lambda x: x, lambda x: F.lit(1.0), 0.1)
    assert sm.count() == len(ROWS)


def test_empty_frames(spark):
    none = frame(spark).limit(0)
    assert folds.last(folds.series(none, "k", ["at"], "v"), {"m": 0.0, "p": 1.0, "ll": 0.0}, folds.kalman_1d()).count() == 0
    assert series.particle_filter(series.observations(none, "k", ["at"], "v"), models.random_walk()).count() == 0


def test_noise_does_not_depend_on_partitions(spark):
    s = spark.range(5).withColumnRenamed("id", "series_id")
    a = pf.prior(spark, s, 20).toPandas()
    b = pf.prior(spark, s.repartition(7), 20).toPandas()
    k = ["series_id", "pid"]
    assert (a.sort_values(k)["x"].values == b.sort_values(k)["x"].values).all()


def test_particle_frame_follows_kalman(spark):
    obs = spark.createDataFrame([(1, t, v) for t, v in enumerate([5.0, 5.5, 6.2], 1)], "series_id long, t int, y double")
    got = pf.bootstrap_filter(spark, obs, 3, 3000, lambda x: x, lambda x: x, 0.5, 2.0, 4.0, 2.0).orderBy("t").toPandas()
    from tidestate.operators import gaussian

    ref, _, ll = gaussian.run(models.random_walk(0.5, 2.0, 4.0, 2.0), np.array([[5.0], [5.5], [6.2]]))
    assert np.abs(got["mean"] - ref[:, 0]).max() < 0.15 and np.abs(got["loglik"] - ll).max() < 0.15


def test_resampled_clouds_are_whole(spark):
    c = spark.createDataFrame([(s, i, float(i), float(-i % 5)) for s in range(3) for i in range(40)], "series_id long, pid int, x double, log_w double")
    w = pf.normalised(c)
    for method in ("systematic", "stratified", "multinomial"):
        out = pf.offspring(w, method, 1)
        assert out.groupBy("series_id").agg(F.countDistinct("pid").alias("n"), F.count("*").alias("m")).where("n = 40 and m = 40").count() == 3
    assert pf.gather(out.select("series_id", "pid", "ancestor"), c).count() == 120


def test_sensor_csv(spark, tmp_path):
    raw = spark.createDataFrame([(1, "2020-01-02 03:04:05", 1.5, "q"), (2, None, 2.0, "q"), (3, "2020-01-02 03:05:05", None, "q")], "a int, b string, c double, d string")
    tables.write_csv(raw, str(tmp_path / "x"))
    got = tables.clean_sensor(tables.read_csv(spark, str(tmp_path / "x"), "a int, b string, c double, d string")).collect()
    assert [tuple(r) for r in got] == [(__import__("datetime").datetime(2020, 1, 2, 3, 4, 5), 1.5)]
    assert tables.clean_sensor(tables.read_csv(spark, str(tmp_path / "x"))).count() == 1


def test_tidy_and_metrics(spark):
    f = series.gaussian_filter(series.observations(frame(spark), "k", ["at"], "v"), models.random_walk())
    assert tables.tidy(f).where("lo < value and value < hi").count() == len(ROWS)
    one = spark.createDataFrame([(1, 2.0)], "series_id long, rmse double")
    assert tables.metrics(a=one, b=one).count() == 2


def test_simulated_models_filter(spark):
    sim = simulate.simulate(spark, "lorenz", 2, 20)
    out = series.gaussian_filter(sim.select("series_id", "t", "ys"), models.lorenz(), "unscented")
    err = pf.rmse(sim, out.select("series_id", "t", F.col("mean").alias("x"))).toPandas()
    assert (err["rmse"] < 10).all()


def streamed(spark, tmp_path, f, name):
    rows = [(k, f"2024-01-01 00:00:{t:02d}", float(k + t)) for k in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "series_id long, s string, y double").select("series_id", F.to_timestamp("s").alias("ts"), "y")
    for i, cut in enumerate((df.where("second(ts) < 5"), df.where("second(ts) >= 5"), df.where("second(ts) = 3"))):
        cut.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = f(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df, spark.table(name).toPandas()


def test_stream_equals_batch(spark, tmp_path):
    m = models.constant_velocity()
    df, got = streamed(spark, tmp_path, lambda s: online.kalman(s, m), "kalman_stream")
    batch = series.gaussian_filter(series.observations(df, "series_id", ["ts"], "y"), m).toPandas()
    a, b = got.sort_values(["series_id", "ts"]), batch.sort_values(["series_id", "t"])
    assert len(a) == 24 and np.allclose(a["mean"], b["mean"].str[0]) and np.allclose(a["loglik"], b["loglik"])


def test_particle_stream(spark, tmp_path):
    _, got = streamed(spark, tmp_path, lambda s: online.bootstrap(s, models.random_walk(1.0, 1.0), 300), "particle_stream")
    last = got.sort_values("ts").groupby("series_id").tail(1)
    assert len(got) == 24 and (np.abs(last["mean"] - last["series_id"] - 11) < 1.5).all()


def test_blocks_equal_the_whole_series(spark):
    from tidestate.plans import blocks

    rows = [(k, t, None if (t + k) % 5 == 0 else float(t % 7 + k)) for k in (1, 2) for t in range(40)] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "k long, at int, v double")
    a = folds.scan(folds.series(df, "k", ["at"], "v"), {"m": 2.0, "p": 3.0, "ll": 0.0}, folds.kalman_1d(0.9, 0.5, 1.2, 2.0)).toPandas()
    b = blocks.kalman_blocks(df, "k", ["at"], "v", F.floor(F.col("at") / 6), 0.9, 0.5, 1.2, 2.0, 2.0, 3.0).toPandas()
    k = ["series_id", "t"]
    a, b = a.sort_values(k), b.sort_values(k)
    assert len(a) == len(b) == len(rows)
    for c in ("m", "p", "ll"):
        assert np.allclose(a[c], b[c])
    assert blocks.kalman_blocks(df.limit(0), "k", ["at"], "v", F.col("at")).count() == 0


def plain_bootstrap(k, ys, n, q, r, mean, var):
    """particle_frame_filter's recursion over one whole series, in plain Python."""
    import hashlib
    import math

    def uniform(*keys):
        return (int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def normal(*keys):
        return math.sqrt(-2 * math.log(uniform(*keys, "a"))) * math.cos(2 * math.pi * uniform(*keys, "b"))

    x = [mean + math.sqrt(var) * normal(0, "prior", k, i) for i in range(n)]
    for t, y in enumerate(ys, 1):
        x = [v + math.sqrt(q) * normal(0, t, k, i) for i, v in enumerate(x)]
        w = [1.0 if y is None else math.exp(-0.5 * (y - v) ** 2 / r) / math.sqrt(2 * math.pi * r) for v in x]
        total = sum(w)
        w = [v / total for v in w]
        m = sum(a * b for a, b in zip(w, x))
        yield k, t, n, m, sum(a * b * b for a, b in zip(w, x)) - m * m, 1 / sum(a * a for a in w), math.log(total / n)
        u, i, hi, picked = uniform(0, "resample", t, k), 0, w[0], []
        for slot in range(n):
            while (slot + u) / n >= hi and i < n - 1:
                i += 1
                hi += w[i]
            picked.append(x[i])
        x = picked


def test_particle_frame_series_takes_every_step(spark):
    ys = {1: [45.0, 52.0, None, 61.0, 40.0, 58.0, 49.0], 2: [70.0], 3: [20.0, 90.0, 35.0, 66.0]}
    obs = spark.createDataFrame([(k, t, [y]) for k, v in ys.items() for t, y in enumerate(v, 1)], "series_id long, t int, ys array<double>")
    got = pf.bootstrap_series(obs.repartition(5), 30, lambda x: x, lambda x: x, 0.1, 400.0, 50.0, 100.0).orderBy("series_id", "t").collect()
    want = [r for k, v in ys.items() for r in plain_bootstrap(k, v, 30, 0.1, 400.0, 50.0, 100.0)]
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([tuple(r)[3:] for r in got], [r[3:] for r in want])


def test_particle_frame_query_covers_all_events(spark, sf):
    from tidestate import queries

    key = ["series_id", "t"]
    got = queries.QUERIES["particle_frame_filter_series"](spark, sf).toPandas().sort_values(key)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(got) == n > 2 * got["series_id"].nunique()
    first = queries.QUERIES["particle_frame_filter"](spark, sf).toPandas().sort_values(key)
    assert np.allclose(got[got["t"] <= 2].values.astype(float), first.values.astype(float), atol=1e-5)


def test_path_draws_are_taken_from_all_paths(spark):
    from tidestate.functions.rand import stream
    from tidestate.operators import smoothing

    m, n, ys = models.random_walk(1.0, 4.0), 20, [1.0, -2.0, 0.5]
    obs = spark.createDataFrame([(k, t, [y]) for k in range(40) for t, y in enumerate(ys, 1)], "series_id long, t int, ys array<double>")
    got = series.trajectories(obs, m, "path", draws=5, n=n).toPandas().sort_values(["series_id", "draw", "t"])
    at = []
    for k, g in got.groupby("series_id"):
        drawn = np.stack(g["x"]).reshape(5, len(ys))
        # the key's type is part of the stream
        for key in (int(k), np.int64(k)):
            paths = smoothing.path_smoother(m, np.array(ys)[:, None], n, stream(0, key))[:, :, 0]
            same = (np.abs(drawn[:, None] - paths[None]) < 1e-12).all(2)
            if same.any(1).all():
                break
        assert same.any(1).all()
        at += [np.flatnonzero(r).mean() for r in same]
    assert 7.5 < np.mean(at) < 11.5  # the middle of 20 paths is 9.5, that of the first five 2
    assert series.trajectories(obs, m, "path", draws=30, n=n).groupBy("series_id", "t").count().where("count = 30").count() == 120


def test_half_way_figures_go_where_duckdb_rounds_them(spark, duck):
    from tidestate import queries

    values = [32.2495, 1.2735, -11.6845, 16.1225, 2.5005, 0.0005]
    got = queries._near(spark.createDataFrame([(0, i, v, v, -v) for i, v in enumerate(values)], "series_id long, t int, m double, p double, loglik double")).orderBy("t").collect()
    want = [duck.execute("SELECT round(CAST(? AS DOUBLE), 3), round(CAST(? AS DOUBLE), 3)", [v, -v]).fetchone() for v in values]
    assert [(r.m, r.loglik) for r in got] == want
