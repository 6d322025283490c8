"""The engine's queries over the driver's tables, and the same in SQL.

Series are the values of `events` of each user in order of (ts, event_id). Figures are rounded to six places.
SQL gives the recurrences as recursive queries; the engine never runs those. Where numpy filters for nonlinear models
run on a linear model, the linear filter's SQL is their oracle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import models
from .functions import columns, linalg
from .functions.rand import normal, normal_sql, uniform_sql
from .operators import estimation
from .plans import blocks, folds, series
from .plans import particle_frames as pf
from .sources import simulate, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROUND = 6


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query, with its SQL if SQL can say it."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def event_series(spark: SparkSession, d: str) -> DataFrame:
    return folds.series(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return series.observations(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, ROUND).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


INIT = {"m": 0.0, "p": 1.0, "ll": 0.0}
S = "s AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS t, value AS y FROM events)"
LOG = "(-0.5 * (ln(2 * pi() * sv) + e * e / sv))"


def sql_1d(predicted_m: str, predicted_p: str, h: str, hm: str, new_p: str = "pp - kk * kk * sv", m0: float = 0.0, p0: float = 1.0, q_r: str = "4.0") -> str:
    """The recursion k of a one-dimensional filter: mp, pp predicted; hm its observation, h the slope."""
    return f"""WITH RECURSIVE {S},
k(series_id, t, y, m, p, ll) AS (
  SELECT DISTINCT series_id, 0, CAST(NULL AS DOUBLE), CAST({m0} AS DOUBLE), CAST({p0} AS DOUBLE), CAST(0 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t, y, CASE WHEN y IS NULL THEN mp ELSE mp + kk * e END, CASE WHEN y IS NULL THEN pp ELSE {new_p} END, CASE WHEN y IS NULL THEN ll ELSE ll + {LOG} END
  FROM (SELECT *, pp * hh / sv AS kk FROM (SELECT *, hh * hh * pp + {q_r} AS sv FROM (SELECT *, {h} AS hh, y - {hm} AS e FROM (
    SELECT s.series_id, s.t, s.y, k.ll, {predicted_m} AS mp, {predicted_p} AS pp FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1))))
)"""


ROWS = "SELECT series_id, t, y, round(m, 6) AS m, round(p, 6) AS p, round(ll, 6) AS ll FROM k WHERE t > 0"
KF_SQL = sql_1d("k.m", "k.p + 0.1", "1.0", "mp")
LAST = "SELECT series_id, CAST(t AS INTEGER) AS n, round(m, 6) AS m, round(p, 6) AS p, round(ll, 6) AS ll FROM (SELECT *, max(t) OVER (PARTITION BY series_id) AS tt FROM k) WHERE t = tt"


@query(f"{KF_SQL} {ROWS}")
def kf_filter(spark: SparkSession, d: str) -> DataFrame:
    """Kalman filter of a random walk: every state of every series, with the running log likelihood."""
    return rounded(folds.scan(event_series(spark, d), INIT, folds.kalman_1d()))


@query(f"{KF_SQL} {ROWS}")
def kf_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same states parallel in time: series are cut into blocks by month, so no task holds a whole series."""
    return rounded(blocks.kalman_blocks(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", F.date_trunc("month", "ts")))


@query(f"{KF_SQL} {LAST}")
def kf_final(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds.last(event_series(spark, d), INIT, folds.kalman_1d()))


@query(f"{KF_SQL} {LAST}")
def kf_joseph_final(spark: SparkSession, d: str) -> DataFrame:
    """The Joseph form gives the same numbers."""
    return rounded(folds.last(event_series(spark, d), INIT, folds.kalman_1d(joseph=True)))


@query(f"{KF_SQL} SELECT series_id, round(ll, 6) AS loglik FROM (SELECT *, max(t) OVER (PARTITION BY series_id) AS tt FROM k) WHERE t = tt")
def kf_loglik(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds.last(event_series(spark, d), INIT, folds.kalman_1d()).select("series_id", F.col("ll").alias("loglik")))


@query(sql_1d("k.m", "k.p", "1.0", "mp", "pp") + " " + ROWS)
def var3d_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(folds.scan(event_series(spark, d), INIT, folds.var3d_1d()))


SINE = (lambda x: x + F.sin(x), lambda x: 1 + F.cos(x), lambda x: x * x / 20, lambda x: x / 10)
SINE_INIT = {"m": 1.0, "p": 1.0, "ll": 0.0}
EKF_SQL = sql_1d("k.m + sin(k.m)", "(1 + cos(k.m)) * (1 + cos(k.m)) * k.p + 1.0", "mp / 10", "mp * mp / 20", m0=1.0, q_r="25.0")


@query(f"{EKF_SQL} {ROWS}")
def ekf_filter(spark: SparkSession, d: str) -> DataFrame:
    """Extended Kalman filter of f = x + sin x, g = x**2 / 20."""
    f, df, g, dg = SINE
    return rounded(folds.scan(event_series(spark, d), SINE_INIT, folds.extended_1d(f, df, g, dg, 1.0, 25.0)))


UKF_SQL = f"""WITH RECURSIVE {S},
k(series_id, t, y, m, p, ll) AS (
  SELECT DISTINCT series_id, 0, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t, y, CASE WHEN y IS NULL THEN mp ELSE mp + cc / sv * e END, CASE WHEN y IS NULL THEN pp ELSE pp - cc * cc / sv END, CASE WHEN y IS NULL THEN ll ELSE ll + {LOG} END FROM (
  SELECT *, y - u AS e, (2.0 / 3) * (z0 - u) * (z0 - u) + ((z1 - u) * (z1 - u) + (z2 - u) * (z2 - u)) / 6.0 + 25.0 AS sv, dd * (z1 - z2) / 6.0 AS cc FROM (
  SELECT *, (2.0 / 3) * z0 + (z1 + z2) / 6.0 AS u FROM (SELECT *, mp * mp / 20 AS z0, (mp + dd) * (mp + dd) / 20 AS z1, (mp - dd) * (mp - dd) / 20 AS z2 FROM (
  SELECT *, sqrt(3 * pp) AS dd FROM (SELECT *, (2.0 / 3) * (x0 - mp) * (x0 - mp) + ((x1 - mp) * (x1 - mp) + (x2 - mp) * (x2 - mp)) / 6.0 + 1.0 AS pp FROM (
  SELECT *, (2.0 / 3) * x0 + (x1 + x2) / 6.0 AS mp FROM (SELECT series_id, t, y, ll, m + sin(m) AS x0, m + d0 + sin(m + d0) AS x1, m - d0 + sin(m - d0) AS x2 FROM (
  SELECT s.series_id, s.t, s.y, k.ll, k.m, sqrt(3 * k.p) AS d0 FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1))))))))
)"""


@query(f"{UKF_SQL} {ROWS}")
def ukf_filter(spark: SparkSession, d: str) -> DataFrame:
    f, _, g, _ = SINE
    return rounded(folds.scan(event_series(spark, d), SINE_INIT, folds.unscented_1d(f, g, 1.0, 25.0)))


CV_SQL = f"""WITH RECURSIVE {S},
k(series_id, t, y, x1, x2, p11, p12, p22, ll) AS (
  SELECT DISTINCT series_id, 0, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t, y, a + b11 / sv * e, b + b12 / sv * e, b11 - b11 * b11 / sv, b12 - b11 * b12 / sv, b22 - b12 * b12 / sv, ll + {LOG} FROM (
  SELECT *, b11 + 100.0 AS sv, y - a AS e FROM (
  SELECT s.series_id, s.t, s.y, k.ll, k.x1 + k.x2 AS a, k.x2 AS b, k.p11 + 2 * k.p12 + k.p22 + 0.01 AS b11, k.p12 + k.p22 AS b12, k.p22 + 1.0 AS b22 FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1))
)"""
CV_FIELDS = ("x1", "x2", "p11", "p12", "p22", "ll")


@query(f"{CV_SQL} SELECT series_id, t, y, {', '.join(f'round({c}, 6) AS {c}' for c in CV_FIELDS)} FROM k WHERE t > 0")
def kf_constant_velocity(spark: SparkSession, d: str) -> DataFrame:
    init = dict(zip(CV_FIELDS, (0.0, 0.0, 1.0, 0.0, 1.0, 0.0), strict=True))
    return rounded(folds.scan(event_series(spark, d), init, folds.kalman_2d([[1, 1], [0, 1]], [[0.01, 0], [0, 1]], 100.0)))


def sql_smoother(forward: str, ahead_m: str, slope: str, q: str) -> str:
    return f"""{forward},
b(series_id, t, m, p, ms, ps, gain) AS (
  SELECT series_id, t, m, p, m, p, CAST(0 AS DOUBLE) FROM (SELECT *, max(t) OVER (PARTITION BY series_id) AS tt FROM k) WHERE t = tt
  UNION ALL
  SELECT series_id, t, m, p, m + g * (msn - am), p + g * g * (psn - ap), g FROM (SELECT *, p * j / ap AS g FROM (
    SELECT *, j * j * p + {q} AS ap FROM (SELECT k.series_id, k.t, k.m, k.p, b.ms AS msn, b.ps AS psn, {ahead_m} AS am, {slope} AS j FROM b JOIN k ON k.series_id = b.series_id AND k.t = b.t - 1 AND k.t > 0)))
) SELECT series_id, t, round(ms, 6) AS ms, round(ps, 6) AS ps, round(gain, 6) AS gain FROM b"""


RTS_SQL = sql_smoother(KF_SQL, "k.m", "1.0", "0.1")
ERTS_SQL = sql_smoother(EKF_SQL, "k.m + sin(k.m)", "1 + cos(k.m)", "1.0")


@query(RTS_SQL)
def rts_smoother(spark: SparkSession, d: str) -> DataFrame:
    filtered = folds.states(event_series(spark, d), INIT, folds.kalman_1d())
    return rounded(folds.smooth_states(filtered, lambda x: x, lambda x: F.lit(1.0), 0.1))


@query(ERTS_SQL)
def extended_rts_smoother(spark: SparkSession, d: str) -> DataFrame:
    f, df, g, dg = SINE
    filtered = folds.states(event_series(spark, d), SINE_INIT, folds.extended_1d(f, df, g, dg, 1.0, 25.0))
    return rounded(folds.smooth_states(filtered, f, df, 1.0))


# numpy filters and smoothers on the linear model: the linear SQL is their oracle

STEP_ROWS = "SELECT series_id, t, round(m, 6) AS m, round(p, 6) AS p, round(ll - coalesce(lag(ll) OVER (PARTITION BY series_id ORDER BY t), 0), 6) AS loglik FROM k"


def _flat(df: DataFrame) -> DataFrame:
    return rounded(df.select("series_id", "t", F.col("mean")[0].alias("m"), F.col("cov")[0][0].alias("p"), "loglik"))


for _method in ("kalman", "extended", "unscented"):

    @query(f"{KF_SQL} SELECT * FROM ({STEP_ROWS}) WHERE t > 0", name=f"series_{_method}_filter")
    def _series_filter(spark: SparkSession, d: str, method: str = _method) -> DataFrame:
        return _flat(series.gaussian_filter(event_rows(spark, d), models.random_walk(), method))

    @query(f"SELECT series_id, t, ms, ps FROM ({RTS_SQL})", name=f"series_{_method}_smoother")
    def _series_smoother(spark: SparkSession, d: str, method: str = _method) -> DataFrame:
        out = series.gaussian_smoother(event_rows(spark, d), models.random_walk(), method)
        return rounded(out.select("series_id", "t", F.col("mean")[0].alias("ms"), F.col("cov")[0][0].alias("ps")))


@query(f"{sql_1d('k.m', 'k.p', '1.0', 'mp', 'pp')} SELECT * FROM ({STEP_ROWS}) WHERE t > 0")
def series_var3d_filter(spark: SparkSession, d: str) -> DataFrame:
    return _flat(series.gaussian_filter(event_rows(spark, d), models.random_walk(), "var3d"))


NEAR = "SELECT series_id, t, round(m, 3) AS m, round(p, 3) AS p, round(loglik, 3) AS loglik FROM ({}) WHERE t > 0"


def _near(df: DataFrame) -> DataFrame:
    """To three places: this model magnifies the last bits, which other orders of operations change. Figures of six places are often half-way
    between two of three: scaled, rounded and scaled back they go where DuckDB's go (Spark's round takes the decimal, not the double)."""
    return df.select("series_id", "t", *[(F.round(F.col(c) * 1000) / 1000).alias(c) for c in ("m", "p", "loglik")])


@query(f"{EKF_SQL} {NEAR.format(STEP_ROWS)}")
def series_extended_nonlinear(spark: SparkSession, d: str) -> DataFrame:
    return _near(_flat(series.gaussian_filter(event_rows(spark, d), models.sine_growth(), "extended")))


@query(f"{UKF_SQL} {NEAR.format(STEP_ROWS)}")
def series_unscented_nonlinear(spark: SparkSession, d: str) -> DataFrame:
    return _near(_flat(series.gaussian_filter(event_rows(spark, d), models.sine_growth(), "unscented")))


# likelihood surfaces

GRID = [(q, r) for q in (0.01, 0.1, 1.0, 10.0) for r in (1.0, 4.0, 100.0)]


@query(
    f"""WITH RECURSIVE {S}, g(q, r) AS (VALUES {', '.join(f'(CAST({q} AS DOUBLE), CAST({r} AS DOUBLE))' for q, r in GRID)}),
k(series_id, q, r, t, m, p, energy) AS (SELECT DISTINCT series_id, q, r, 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM s, g
  UNION ALL SELECT series_id, q, r, t, m + (pp / sv) * e, pp - pp * pp / sv, energy - {LOG} FROM (SELECT *, pp + r AS sv, y - m AS e FROM (
    SELECT k.series_id, k.q, k.r, s.t, s.y, k.m, k.p + k.q AS pp, k.energy FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1)))
SELECT q, r, round(sum(energy), 4) AS energy, count(*) AS series FROM (SELECT *, max(t) OVER (PARTITION BY series_id, q, r) AS tt FROM k) WHERE t = tt GROUP BY q, r"""
)
def energy_grid(spark: SparkSession, d: str) -> DataFrame:
    """Negative log likelihood of all series at each point of a parameter grid: every point is folded over a series' array where it stands."""
    grid = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(float(r)).alias("r")) for q, r in GRID])
    kind = "struct<m:double,p:double,ll:double>"
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("p"), F.lit(0.0).alias("ll")).cast(kind)

    def point(g: F.Column) -> F.Column:
        ll = F.aggregate("ys", zero, lambda a, y: folds.kalman_1d(q=g["q"], r=g["r"])(a, y).cast(kind), lambda a: a["ll"])
        return F.struct(g["q"].alias("q"), g["r"].alias("r"), ll.alias("ll"))

    points = event_series(spark, d).select(F.inline(F.transform(grid, point)))
    return points.groupBy("q", "r").agg(F.round(-F.sum("ll"), 4).alias("energy"), F.count("*").alias("series"))


# sources, projections, filters

@query("SELECT date_trunc('second', ts) AS \"DateTime\", value AS \"Temperature\" FROM events WHERE ts IS NOT NULL AND value IS NOT NULL")
def sensor_clean(spark: SparkSession, d: str) -> DataFrame:
    """Columns two and three by position, renamed, complete rows only, times parsed from text."""
    raw = read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "value", "event_type")
    return tables.clean_sensor(raw)


@query("SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV to the shared folder and read back with its schema."""
    path = tables.shared_path(spark, "csv")
    tables.write_csv(read(spark, d, "events").select("event_id", "user_id", "value").na.drop(), path)
    return tables.read_csv(spark, path, "event_id long, user_id long, value double")


@query(f"SELECT id AS event_id, round({normal_sql('7', 'id')}, 6) AS z, round({uniform_sql('7', 'id')}, 6) AS u FROM (SELECT event_id AS id FROM events)")
def keyed_noise(spark: SparkSession, d: str) -> DataFrame:
    from .functions.rand import uniform

    return rounded(read(spark, d, "events").select("event_id", normal(7, F.col("event_id")).alias("z"), uniform(7, F.col("event_id")).alias("u")))


@query(
    f"""WITH i AS (SELECT s AS series_id, t FROM range(20) a(s), range(1, 101) b(t)),
v AS (SELECT *, sum(z) OVER (PARTITION BY series_id ORDER BY t) AS x2 FROM (SELECT *, {normal_sql('0', "'v'", 'series_id', 't')} AS z, 0.1 * {normal_sql('0', "'x'", 'series_id', 't')} AS zx FROM i)),
x AS (SELECT *, coalesce(sum(x2) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(zx) OVER (PARTITION BY series_id ORDER BY t) AS x1 FROM v)
SELECT series_id, CAST(t AS INTEGER) AS t, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x1 + 10 * {normal_sql('0', "'y'", 'series_id', 't')}, 6) AS y FROM x"""
)
def simulate_constant_velocity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(simulate.constant_velocity(spark, 20, 100))


# weights, moments, resampling

W = "w AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pid, value AS x FROM events)"
LW = f"{W}, l AS (SELECT *, -0.5 * (ln(2 * pi() * 400.0) + (50 - x) * (50 - x) / 400.0) AS log_w FROM w), n AS (SELECT *, exp(log_w) / sum(exp(log_w)) OVER (PARTITION BY series_id) AS wt, ln(sum(exp(log_w)) OVER (PARTITION BY series_id)) - ln(count(*) OVER (PARTITION BY series_id)) AS log_mean FROM l)"


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as particles, weighed by a normal density around 50."""
    pid = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    c = read(spark, d, "events").select(F.col("user_id").alias("series_id"), pid.cast("int").alias("pid"), F.col("value").alias("x"))
    return pf.normalised(pf.weighed(c.withColumn("y", F.lit(50.0)), lambda x: x, 400.0)).drop("y")


@query(f"WITH {LW} SELECT series_id, pid, round(x, 6) AS x, round(log_w, 6) AS log_w, round(wt, 9) AS w, round(log_mean, 6) AS log_mean FROM n")
def weights_normalised(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).select("series_id", "pid", F.round("x", 6).alias("x"), F.round("log_w", 6).alias("log_w"), F.round("w", 9).alias("w"), F.round("log_mean", 6).alias("log_mean"))


@query(f"WITH {LW} SELECT series_id, count(*) AS n, round(sum(wt * x), 6) AS mean, round(sum(wt * x * x) - sum(wt * x) * sum(wt * x), 6) AS var, round(1 / sum(wt * wt), 6) AS ess, round(max(log_mean), 6) AS loglik FROM n GROUP BY series_id")
def weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pf.moments(cloud(spark, d)))


CUM = f"{LW}, c AS (SELECT *, sum(wt) OVER v AS h0, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY pid DESC) = 1 AS fin FROM n WINDOW v AS (PARTITION BY series_id ORDER BY pid ROWS UNBOUNDED PRECEDING)), ci AS (SELECT *, h0 - wt AS lo, CASE WHEN fin THEN 1.0 ELSE h0 END AS hi FROM c)"


@query(f"WITH {CUM} SELECT series_id, pid, round(lo, 9) AS lo, round(hi, 9) AS hi FROM ci")
def weights_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return pf.cumulative(cloud(spark, d)).select("series_id", "pid", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def sql_resample(position: str) -> str:
    return f"WITH {CUM}, pos AS (SELECT series_id, pid AS slot, {position} AS u FROM ci) SELECT p.series_id, CAST(p.slot AS INTEGER) AS pid, ci.pid AS ancestor, ci.x AS x FROM pos p JOIN ci ON ci.series_id = p.series_id AND p.u >= ci.lo AND p.u < ci.hi"


_KEYS = ("0", "'resample'", "1", "series_id")
for _kind, _pos in (
    ("systematic", f"(pid + {uniform_sql(*_KEYS)}) / n"),
    ("stratified", f"(pid + {uniform_sql(*_KEYS, 'pid')}) / n"),
    ("multinomial", uniform_sql(*_KEYS, "pid")),
):

    @query(sql_resample(_pos), name=f"resample_{_kind}")
    def _resample(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return pf.offspring(cloud(spark, d), kind, 1).select("series_id", "pid", "ancestor", "x")


BPF_N = 50
BPF_SQL = f"""WITH u AS (SELECT user_id AS series_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
p0 AS (SELECT series_id, pid, sqrt(100.0) * {normal_sql('0', "'prior'", 'series_id', 'pid')} + 50 AS x FROM (SELECT DISTINCT series_id FROM u), range({BPF_N}) r(pid))"""
for _t in (1, 2):
    BPF_SQL += f""", x{_t} AS (SELECT p.series_id, pid, x + sqrt(0.1) * {normal_sql('0', str(_t), 'p.series_id', 'pid')} AS x, y FROM p{_t - 1} p JOIN u ON u.series_id = p.series_id AND u.t = {_t}),
l{_t} AS (SELECT *, -0.5 * (ln(2 * pi() * 400.0) + (y - x) * (y - x) / 400.0) AS lw FROM x{_t}),
w{_t} AS (SELECT *, exp(lw) / sum(exp(lw)) OVER (PARTITION BY series_id) AS w, ln(avg(exp(lw)) OVER (PARTITION BY series_id)) AS lm FROM l{_t}),
c{_t} AS (SELECT *, sum(w) OVER (PARTITION BY series_id ORDER BY pid ROWS UNBOUNDED PRECEDING) AS h0 FROM w{_t}),
i{_t} AS (SELECT *, h0 - w AS lo, CASE WHEN pid = {BPF_N - 1} THEN 1.0 ELSE h0 END AS hi FROM c{_t}),
p{_t} AS (SELECT q.series_id, q.pid, i.x FROM (SELECT series_id, pid, (pid + {uniform_sql('0', "'resample'", str(_t), 'series_id')}) / {BPF_N} AS pos FROM i{_t}) q JOIN i{_t} i ON i.series_id = q.series_id AND q.pos >= i.lo AND q.pos < i.hi)"""
BPF_SQL += " UNION ALL ".join(f"{'' if t > 1 else ' '}SELECT series_id, {t} AS t, count(*) AS n, round(sum(w * x), 6) AS mean, round(sum(w * x * x) - sum(w * x) * sum(w * x), 6) AS var, round(1 / sum(w * w), 6) AS ess, round(max(lm), 6) AS loglik FROM w{t} GROUP BY series_id" for t in (1, 2))


@query(BPF_SQL)
def particle_frame_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two bootstrap steps with particles as rows, noise keyed by (step, series, particle)."""
    obs = event_rows(spark, d).select("series_id", "t", F.col("ys")[0].alias("y"))
    return rounded(pf.bootstrap_filter(spark, obs, 2, BPF_N, lambda x: x, lambda x: x, 0.1, 400.0, 50.0, 100.0, cut=False))


@query()
def particle_frame_filter_series(spark: SparkSession, d: str) -> DataFrame:
    """The same filter over all steps of every series. particle_frame_filter is its first two, as far as its SQL is unrolled."""
    return rounded(pf.bootstrap_series(event_rows(spark, d), BPF_N, lambda x: x, lambda x: x, 0.1, 400.0, 50.0, 100.0))


@query(f"WITH {LW}, b AS (SELECT * FROM n) SELECT a.series_id, a.pid, round(sum(b.wt * exp(-0.5 * (a.x - b.x) * (a.x - b.x) / 4.0) / sqrt(2 * pi() * 4.0)), 9) AS mix FROM b a JOIN b ON a.series_id = b.series_id GROUP BY a.series_id, a.pid")
def transition_mixture(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return pf.transition_mixture(c, c, lambda x: x, 4.0).select("series_id", "pid", F.round("mix", 9).alias("mix"))


@query("WITH e AS (SELECT user_id AS series_id, event_id AS draw, value FROM events) SELECT series_id, draw FROM e WHERE NOT (value <= 50 AND value IS NOT NULL)")
def rejection_pending(spark: SparkSession, d: str) -> DataFrame:
    """What a rejection round leaves: an anti join of the draws with the accepted."""
    e = read(spark, d, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("draw"), "value")
    return pf.pending(e.select("series_id", "draw"), e.where("value <= 50").select("series_id", "draw"))


@query(f"{KF_SQL} SELECT series_id, t, round(loglik, 6) AS loglik, round(-ll, 6) AS energy FROM (SELECT *, ll - lag(ll) OVER (PARTITION BY series_id ORDER BY t) AS loglik FROM k) WHERE t > 0")
def energy_running(spark: SparkSession, d: str) -> DataFrame:
    filtered = series.gaussian_filter(event_rows(spark, d), models.random_walk())
    return rounded(pf.energy(filtered.select("series_id", "t", "loglik")))


@query(f"{KF_SQL} SELECT series_id, round(sqrt(avg((y - m) * (y - m))), 6) AS rmse FROM k WHERE t > 0 GROUP BY series_id")
def filter_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Observations against filtered means."""
    obs = event_rows(spark, d)
    est = series.gaussian_filter(obs, models.random_walk()).select("series_id", "t", F.col("mean").alias("x"))
    return rounded(pf.rmse(obs.select("series_id", "t", F.col("ys").alias("x")), est))


# control, linear algebra, quasi-random points: small tables made on the driver

_DT, _QC = 0.1, 0.5


@query(f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CAST(a AS DOUBLE), 9) AS a, round(CAST(q AS DOUBLE), 9) AS q FROM (VALUES (0, 0, 1.0, {_QC * _DT**3 / 3:.15f}), (0, 1, {_DT}, {_QC * _DT**2 / 2:.15f}), (1, 0, 0.0, {_QC * _DT**2 / 2:.15f}), (1, 1, 1.0, {_QC * _DT:.15f})) v(i, j, a, q)")
def lti_discretisation(spark: SparkSession, d: str) -> DataFrame:
    """White-noise acceleration over 0.1: transition and noise covariance by matrix exponentials."""
    a, q = linalg.lti_discretise([[0, 1], [0, 0]], [[0], [1]], [[_QC]], _DT)
    rows = [(i, j, round(float(a[i, j]), 9), round(float(q[i, j]), 9)) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "i int, j int, a double, q double")


# stochastic queries: rows only

_SIM = {"draws": 5, "n": 50}


def _methods() -> None:
    for method in ("bootstrap", "quasi_bootstrap", "auxiliary", "improved_auxiliary", "sir_extended", "sir_unscented"):

        @query(name=f"particle_{method}")
        def _particle(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            return series.particle_filter(event_rows(spark, d), models.random_walk(), method, _SIM["n"])

    for method in ("bootstrap", "quasi_bootstrap", "auxiliary", "sir_extended_general"):

        @query(name=f"particle_general_{method}")
        def _general(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            sim = simulate.simulate(spark, "stochastic_volatility", 8, 40)
            return series.particle_filter(sim.select("series_id", "t", "ys"), models.stochastic_volatility(), method, _SIM["n"])

    for method in ("backward", "rejection", "path", "ancestral"):

        @query(name=f"trajectories_{method}")
        def _paths(spark: SparkSession, d: str, method: str = method) -> DataFrame:
            return series.trajectories(event_rows(spark, d), models.random_walk(), method, **_SIM)

    for name in models.EXAMPLES:

        @query(name=f"simulate_{name}" + ("_series" if name == "constant_velocity" else ""))
        def _sim(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            return simulate.simulate(spark, name, 8, 50)

    for diffusion in (0.0, 3.0):

        @query(name="simulate_lorenz_" + ("sde" if diffusion else "ode"))
        def _lorenz(spark: SparkSession, d: str, diffusion: float = diffusion) -> DataFrame:
            return simulate.lorenz_paths(spark, 8, 200, diffusion=diffusion)


_methods()


@query()
def trajectories_mean(spark: SparkSession, d: str) -> DataFrame:
    return series.mean_trajectory(series.trajectories(event_rows(spark, d), models.random_walk(), "backward", **_SIM))


def _cube_obs(spark: SparkSession) -> DataFrame:
    return simulate.simulate(spark, "cube_root", 4, 40).select("series_id", "t", "ys")


@query()
def resample_move(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap steps with Metropolis-Hastings moves; the mean of each step's particles."""
    import pandas as pd

    from .functions.rand import stream
    from .operators import particles

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, ys = series.matrix(g)
        steps, paths = particles.run_resample_move(models.cube_root(), ys, 60, stream(0, int(key[0])))
        return pd.DataFrame({"series_id": key[0], "t": t, "mean": list(paths.mean(0)), "loglik": [s.loglik for s in steps]})

    return _cube_obs(spark).groupBy("series_id").applyInPandas(run, "series_id long, t int, mean array<double>, loglik double")


def _chain(f: Callable, steps: int, chains: int = 2) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return series.chains(_cube_obs(spark), functools.partial(f, steps=steps), chains)

    return run


def _noise(ys: np.ndarray, rng: np.random.Generator, steps: int) -> list[dict]:
    return estimation.noise_chain(models.cube_root(), ys, steps, rng, n=40)


def _parameter(ys: np.ndarray, rng: np.random.Generator, steps: int) -> list[dict]:
    return estimation.parameter_chain(models.cube_root(), ys, steps, rng, n=40)


def _roots(ys: np.ndarray, rng: np.random.Generator, steps: int) -> list[dict]:
    return estimation.root_chain(models.cube_root(), ys, steps, rng, n=40)


def _gibbs(ys: np.ndarray, rng: np.random.Generator, steps: int) -> list[dict]:
    return estimation.gibbs_parameters(models.cube_root(), ys, np.zeros((len(ys), 2)), steps, rng, n=30)


query(name="pmmh_noises")(_chain(_noise, 10))
query(name="pmmh_parameters")(_chain(_parameter, 10))
query(name="pmmh_roots")(_chain(_roots, 10))
query(name="particle_gibbs_backward")(_chain(_gibbs, 5))


@query()
def pmmh_burnt_in(spark: SparkSession, d: str) -> DataFrame:
    return series.burnt_in(QUERIES["pmmh_parameters"](spark, d), 0.3)


@query()
def particle_gibbs_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Paths of particle Gibbs with ancestor sampling: the mean path of each series."""
    import pandas as pd

    from .functions.rand import stream

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, ys = series.matrix(g)
        paths = estimation.particle_gibbs(models.cube_root(), ys, np.zeros((len(ys), 2)), 5, 30, stream(0, int(key[0])))
        return pd.DataFrame({"series_id": key[0], "t": t, "mean": list(paths.mean(0))})

    return _cube_obs(spark).groupBy("series_id").applyInPandas(run, "series_id long, t int, mean array<double>")


@query()
def sir_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Estimated and exact log likelihood of each user's series."""
    import pandas as pd

    from .functions.rand import stream

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, ys = series.matrix(g)
        m = models.random_walk(1.0, 400.0, 50.0, 100.0)
        return pd.DataFrame({"series_id": [key[0]], "estimated": [estimation.sir_loglik(m, ys, 200, stream(0, int(key[0])))], "exact": [estimation.kalman_loglik(m, ys)]})

    return event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, estimated double, exact double")


@query()
def gradient_ascent(spark: SparkSession, d: str) -> DataFrame:
    """Up the likelihood of each user's series in log q and log r: 40 rounds."""
    import pandas as pd

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, ys = series.matrix(g)
        x, seen = estimation.gradient_ascent(lambda v: estimation.kalman_loglik(models.random_walk(np.exp(v[0]), np.exp(v[1]), 50.0, 100.0), ys) / len(ys), np.array([0.0, 5.0]), 0.2, 40)
        return pd.DataFrame({"series_id": [key[0]], "log_q": [x[0]], "log_r": [x[1]], "first": [seen[0]], "last": [seen[-1]]})

    return event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, log_q double, log_r double, first double, last double")


# likelihoods, lookups and small functions with an SQL form


@query(
    f"""WITH RECURSIVE {S}, o AS (SELECT *, 0.1 * t AS q, 1 + t % 5 AS r FROM s),
k(series_id, t, y, m, p, ll) AS (SELECT DISTINCT series_id, 0, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM s
  UNION ALL SELECT series_id, t, y, m + (pp / sv) * e, pp - pp * pp / sv, ll + {LOG} FROM (SELECT *, pp + r AS sv, y - m AS e FROM (
    SELECT o.series_id, o.t, o.y, k.m, k.p + o.q AS pp, o.r, k.ll FROM k JOIN o ON o.series_id = k.series_id AND o.t = k.t + 1))) {ROWS}"""
)
def kf_time_varying(spark: SparkSession, d: str) -> DataFrame:
    """Noises of each step's own, looked up by series and step."""
    obs = event_rows(spark, d).select("series_id", "t", F.col("ys")[0].alias("y"))
    params = obs.select("series_id", "t", (F.lit(0.1) * F.col("t")).alias("q"), (1 + F.col("t") % 5).alias("r"))
    return rounded(folds.time_varying(obs, params, "series_id", ["t"], "y", INIT, lambda q, r: folds.kalman_1d(q=q, r=r), ["q", "r"]))


_P = np.linalg.inv([[9.0, 3.0], [3.0, 4.0]])


@query(f"SELECT l_orderkey, l_linenumber, round(exp(-0.5 * ({_P[0, 0]!r} * a * a + 2 * {_P[0, 1]!r} * a * b + {_P[1, 1]!r} * b * b)) / (2 * pi() * sqrt(27.0)), 9) AS pdf FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 - 2 AS a, l_discount * 100 - 5 AS b FROM lineitem)".replace("np.float64(", "("))
def mvn_density(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 100).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.round(columns.mvn_pdf([F.col("a"), F.col("b")], [2.0, 5.0], [[9.0, 3.0], [3.0, 4.0]]), 9).alias("pdf"))


@query("SELECT round(sqrt(2 * pi()), 9) AS integral")
def cubature_gauss(spark: SparkSession, d: str) -> DataFrame:
    """The integral of exp(-x**2 / 2) over [-100, 100]."""
    nodes = columns.cubature(spark, [-100.0], [100.0], 16, 64)
    return nodes.agg(F.round(F.sum(F.col("w") * F.exp(-F.col("x")[0] * F.col("x")[0] / 2)), 9).alias("integral"))


@query("SELECT event_id, round(exp(-0.5 * (value - 50) * (value - 50) / 401.0) / sqrt(2 * pi() * 401.0), 9) AS likelihood FROM events")
def marginal_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """p(y | previous state 50) with Q = 1 and R = 400: the one-step density integrated over the state by cubature rows."""
    nodes = columns.cubature(spark, [40.0], [60.0], 16, 2)
    x = F.col("x")[0]
    weights = nodes.select(x.alias("x"), (F.col("w") * columns.normal_pdf(x, 50.0, 1.0)).alias("w"))
    # 32 nodes: a literal array, folded for each row
    grid = F.array(*[F.struct(F.lit(r.x).alias("x"), F.lit(r.w).alias("w")) for r in weights.collect()])
    total = F.aggregate(grid, F.lit(0.0), lambda acc, n: acc + n["w"] * columns.normal_pdf(F.col("value"), n["x"], 400.0))
    return read(spark, d, "events").select("event_id", F.round(total, 9).alias("likelihood"))


@query(f"{KF_SQL} SELECT series_id, t, round(m, 6) AS m, round(lag(m) OVER w, 6) AS before, round(lead(m) OVER w, 6) AS after, round(sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS block FROM k WHERE t > 0 WINDOW w AS (PARTITION BY series_id ORDER BY t)")
def neighbours_and_lag_block(spark: SparkSession, d: str) -> DataFrame:
    """Previous and next state, and the sum of a fixed lag of five observations."""
    w = Window.partitionBy("series_id").orderBy("t")
    f = folds.scan(event_series(spark, d), INIT, folds.kalman_1d())
    return rounded(f.select("series_id", "t", "m", F.lag("m").over(w).alias("before"), F.lead("m").over(w).alias("after"), F.sum("y").over(w.rowsBetween(-4, 0)).alias("block")))


@query(f"WITH {LW} SELECT series_id, round(var_samp(x), 6) AS sample_var, round(var_samp(wt * x), 9) AS compat_var, round(max_by(x, pid), 6) AS last_x, round(ln(sum(exp(log_w))) - ln(count(*)), 6) AS log_mean FROM n GROUP BY series_id")
def cloud_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Unweighted sample variance, the variance of weight-scaled particles, the last particle, the log mean weight."""
    c = cloud(spark, d)
    return c.groupBy("series_id").agg(F.round(F.var_samp("x"), 6).alias("sample_var"), F.round(columns.compat_covariance(F.col("w"), F.col("x")), 9).alias("compat_var"), F.round(F.max_by("x", "pid"), 6).alias("last_x"), F.round(F.log(F.sum(F.exp("log_w"))) - F.log(F.count("*")), 6).alias("log_mean"))


@query(f"SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {uniform_sql(chr(39) + 'shuffle' + chr(39), 'event_id')}) AS INTEGER) AS place FROM events")
def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(columns.shuffled(F.col("event_id")))
    return read(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query(f"{sql_1d('k.m', 'k.p + 0.1', '1.0', 'mp')}, g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS b FROM k WHERE t > 0) SELECT series_id, round(m, 6) AS last_mean, round(1.96 * sqrt(p), 6) AS width FROM g WHERE b = 1")
def last_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest mean of each series with the half width of its ribbon."""
    f = tables.tidy(series.gaussian_filter(event_rows(spark, d), models.random_walk()))
    return rounded(f.groupBy("series_id").agg(F.max_by("value", "t").alias("last_mean"), F.max_by((F.col("hi") - F.col("lo")) / 2, "t").alias("width")))


@query(f"{KF_SQL}, st AS (SELECT user_id AS series_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS t FROM events) SELECT series_id, CAST(epoch_us(ts) AS BIGINT) AS at, round(m, 6) AS mean, round(p, 6) AS var FROM k JOIN st USING (series_id, t)")
def stream_kalman(spark: SparkSession, d: str) -> DataFrame:
    """The online filter over events as a stream (all that is there, then it stops), through a file sink."""
    from .sources.tables import shared_path
    from .streaming import online

    static = read(spark, d, "events")
    rows = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"))
    out, mark = shared_path(spark, "stream-out"), shared_path(spark, "stream-mark")
    online.kalman(rows, models.random_walk()).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(online.OUT).parquet(out)
    return rounded(got.select("series_id", F.unix_micros("ts").alias("at"), "mean", "var"))


@query()
def quasi_normals(spark: SparkSession, d: str) -> DataFrame:
    """Normals from lattice points, a lattice a user."""
    import pandas as pd

    from .functions.rand import quasi_normals, stream

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z = quasi_normals(len(g), 2, rng=stream("qmc", int(key[0])))
        return pd.DataFrame({"series_id": key[0], "i": np.arange(len(g)), "z1": z[:, 0], "z2": z[:, 1]})

    return event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, i int, z1 double, z2 double")


@query()
def series_extended_general(spark: SparkSession, d: str) -> DataFrame:
    """The extended filter for general noise, f(x, e) and g(x, e), linearised by differences (tests hold it against the additive one)."""
    import pandas as pd

    from .operators import gaussian

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, ys = series.matrix(g)
        m, p, out = np.zeros(1), np.eye(1), []
        for y in ys:
            m, p = gaussian.extended_predict_general(m, p, lambda x, e: x + e, 0.1 * np.eye(1))
            ll = 0.0
            if not np.isnan(y).any():
                u = gaussian.extended_update_general(m, p, y, lambda x, e: x + e, 4 * np.eye(1))
                m, p, ll = u.mean, u.cov, u.loglik
            out.append((m[0], p[0, 0], ll))
        a = np.array(out)
        return pd.DataFrame({"series_id": key[0], "t": t, "m": a[:, 0], "p": a[:, 1], "loglik": a[:, 2]})

    return _near(event_rows(spark, d).groupBy("series_id").applyInPandas(run, "series_id long, t int, m double, p double, loglik double"))


from . import checked  # noqa: E402, F401  (registers its queries)
