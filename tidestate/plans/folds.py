"""Gaussian filters and smoothers inside Catalyst: a series is an ordered array, a filter a fold over it.

Intermediates of a step are bound once by `let`, since lambda bodies share no subexpressions. One
exchange brings a series together; no Python runs. A fold that appends copies what it has at each step, so long arrays are
folded slice by slice (`folded`), which keeps the work near proportion to the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column, Column], dict[str, Column]]


def let(bindings: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct in which each binding is evaluated once."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in bindings.items()])), body), 1)


def lets(*steps: Callable[[Column | None], dict[str, Column]], end: Callable[..., Column]) -> Column:
    """Nested lets: each step sees the structs before it."""

    def go(i: int, seen: tuple[Column, ...]) -> Column:
        if i == len(steps):
            return end(*seen)
        return let(steps[i](*seen), lambda s: go(i + 1, (*seen, s)))

    return go(0, ())


def series(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """key, ys: each key's values as an array in order (nulls kept)."""
    item = F.struct(*order, F.col(value).cast("double").alias("y"))
    return df.groupBy(F.col(key).alias("series_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["y"]).alias("ys"))


#: Steps of a slice.
SLICE = 128


def folded(array: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """array<kind> of the states after each element. zero: the state before the first, of that kind.

    Within a slice the states are appended one by one; slices are appended whole and flattened at the end.
    """
    some = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return let({"n": step(acc["s"], x).cast(kind)}, lambda b: F.struct(b["n"].alias("s"), F.concat(acc["out"], F.array(b["n"])).alias("out")))

    def slices(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(SLICE))

        def more(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(a, i, F.lit(SLICE)), F.struct(acc["s"].alias("s"), some.alias("out")), one)
            return let({"p": part}, lambda b: F.struct(b["p"]["s"].alias("s"), F.concat(acc["out"], F.array(b["p"]["out"])).alias("out")))

        return F.aggregate(starts, F.struct(zero.cast(kind).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), more, lambda acc: F.flatten(acc["out"]))

    return F.element_at(F.transform(F.array(array), slices), 1)


def states(df: DataFrame, init: dict[str, float], step: Callable[[Column, Column], Column]) -> DataFrame:
    """series_id, ys and states, the array of states (structs of init's fields) after each observation. step(state, y) gives the next state."""
    kind = "struct<" + ",".join(f"{f}:double" for f in init) + ">"
    zero = F.struct(*[F.lit(float(v)).alias(f) for f, v in init.items()])
    return df.withColumn("states", folded(F.col("ys"), zero, kind, step))


def scan(df: DataFrame, init: dict[str, float], step: Callable[[Column, Column], Column]) -> DataFrame:
    """states with a row a step: series_id, t (from 1), y and the state's fields."""
    rows = states(df, init, step).select("series_id", F.posexplode(F.arrays_zip("ys", "states")).alias("i", "z"))
    return rows.select("series_id", (F.col("i") + 1).alias("t"), F.col("z.ys").alias("y"), *[F.col(f"z.states.{f}").alias(f) for f in init])


def time_varying(df: DataFrame, params: DataFrame, key: str, order: Sequence[str], value: str, init: dict[str, float], make: Callable[..., Callable[[Column, Column], Column]], names: Sequence[str]) -> DataFrame:
    """As scan, with a model of its own for each row: params (key, *order, *names) are joined on key and order, and make(**names) gives the row's step."""
    rows = df.join(params, [key, *order])
    item = F.struct(*order, F.col(value).cast("double").alias("y"), *[F.col(n).cast("double").alias(n) for n in names])
    s = rows.groupBy(F.col(key).alias("series_id")).agg(F.array_sort(F.collect_list(item)).alias("ys"))
    out = scan(s, init, lambda state, x: make(**{n: x[n] for n in names})(state, x["y"]))
    return out.withColumn("y", F.col("y.y"))


def last(df: DataFrame, init: dict[str, float], step: Callable[[Column, Column], Column]) -> DataFrame:
    """series_id, n and the state's fields after the last observation: a fold that keeps no history."""
    kind = "struct<" + ",".join(f"{f}:double" for f in init) + ">"
    zero = F.struct(*[F.lit(float(v)).alias(f) for f, v in init.items()]).cast(kind)
    return df.select("series_id", F.size("ys").alias("n"), F.aggregate("ys", zero, lambda s, y: step(s, y).cast(kind)).alias("s")).select("series_id", "n", *[F.col(f"s.{f}").alias(f) for f in init])


def gaussian_log(e: Column, s: Column) -> Column:
    return -0.5 * (F.log(2 * F.pi() * s) + e * e / s)


def observed(y: Column, yes: Column, no: Column) -> Column:
    return F.when(y.isNotNull(), yes).otherwise(no)


def kalman_1d(a: float = 1.0, q: float = 0.1, h: float = 1.0, r: float = 4.0, joseph: bool = False) -> Callable[[Column, Column], Column]:
    """State m, p, ll (running log likelihood)."""

    def step(s: Column, y: Column) -> Column:
        return lets(
            lambda: {"m": a * s["m"], "p": a * a * s["p"] + q},
            lambda f: {"e": y - h * f["m"], "s": h * h * f["p"] + r},
            lambda f, g: {"k": f["p"] * h / g["s"]},
            end=lambda f, g, k: observed(
                y,
                F.struct((f["m"] + k["k"] * g["e"]).alias("m"), ((1 - k["k"] * h) * (1 - k["k"] * h) * f["p"] + k["k"] * k["k"] * r if joseph else (1 - k["k"] * h) * f["p"]).alias("p"), (s["ll"] + gaussian_log(g["e"], g["s"])).alias("ll")),
                F.struct(f["m"].alias("m"), f["p"].alias("p"), s["ll"].alias("ll")),
            ),
        )

    return step


def var3d_1d(a: float = 1.0, h: float = 1.0, r: float = 4.0) -> Callable[[Column, Column], Column]:
    """As kalman_1d with a frozen p."""

    def step(s: Column, y: Column) -> Column:
        return lets(
            lambda: {"m": a * s["m"], "s": h * h * s["p"] + r},
            lambda f: {"e": y - h * f["m"], "k": s["p"] * h / f["s"]},
            end=lambda f, g: observed(y, F.struct((f["m"] + g["k"] * g["e"]).alias("m"), s["p"].alias("p"), (s["ll"] + gaussian_log(g["e"], f["s"])).alias("ll")), F.struct(f["m"].alias("m"), s["p"].alias("p"), s["ll"].alias("ll"))),
        )

    return step


def extended_1d(f: Callable, df: Callable, g: Callable, dg: Callable, q: float, r: float) -> Callable[[Column, Column], Column]:
    """f, g and their derivatives map Columns."""

    def step(s: Column, y: Column) -> Column:
        return lets(
            lambda: {"m": f(s["m"]), "j": df(s["m"])},
            lambda a: {"p": a["j"] * a["j"] * s["p"] + q, "e": y - g(a["m"]), "h": dg(a["m"])},
            lambda a, b: {"s": b["h"] * b["h"] * b["p"] + r},
            lambda a, b, c: {"k": b["p"] * b["h"] / c["s"]},
            end=lambda a, b, c, k: observed(
                y,
                F.struct((a["m"] + k["k"] * b["e"]).alias("m"), (b["p"] - k["k"] * k["k"] * c["s"]).alias("p"), (s["ll"] + gaussian_log(b["e"], c["s"])).alias("ll")),
                F.struct(a["m"].alias("m"), b["p"].alias("p"), s["ll"].alias("ll")),
            ),
        )

    return step


def unscented_1d(f: Callable, g: Callable, q: float, r: float, alpha: float = 1.0, kappa: float = 2.0, beta: float = 0.0) -> Callable[[Column, Column], Column]:
    lam = alpha * alpha * (1 + kappa) - 1
    side, centre = 1 / (2 * (1 + lam)), lam / (1 + lam)
    cov0 = centre + 1 - alpha * alpha + beta

    def spread(m: Column, p: Column) -> Column:
        return F.sqrt((1 + lam) * p)

    def step(s: Column, y: Column) -> Column:
        return lets(
            lambda: {"d": spread(s["m"], s["p"])},
            lambda a: {"x0": f(s["m"]), "x1": f(s["m"] + a["d"]), "x2": f(s["m"] - a["d"])},
            lambda a, b: {"m": centre * b["x0"] + side * (b["x1"] + b["x2"])},
            lambda a, b, c: {"p": cov0 * (b["x0"] - c["m"]) * (b["x0"] - c["m"]) + side * ((b["x1"] - c["m"]) * (b["x1"] - c["m"]) + (b["x2"] - c["m"]) * (b["x2"] - c["m"])) + q},
            lambda a, b, c, d: {"d": spread(c["m"], d["p"])},
            lambda a, b, c, d, e: {"z0": g(c["m"]), "z1": g(c["m"] + e["d"]), "z2": g(c["m"] - e["d"])},
            lambda a, b, c, d, e, z: {"u": centre * z["z0"] + side * (z["z1"] + z["z2"])},
            lambda a, b, c, d, e, z, u: {"s": cov0 * (z["z0"] - u["u"]) * (z["z0"] - u["u"]) + side * ((z["z1"] - u["u"]) * (z["z1"] - u["u"]) + (z["z2"] - u["u"]) * (z["z2"] - u["u"])) + r, "c": side * e["d"] * (z["z1"] - z["z2"])},
            lambda a, b, c, d, e, z, u, v: {"k": v["c"] / v["s"], "e": y - u["u"]},
            end=lambda a, b, c, d, e, z, u, v, k: observed(
                y,
                F.struct((c["m"] + k["k"] * k["e"]).alias("m"), (d["p"] - k["k"] * k["k"] * v["s"]).alias("p"), (s["ll"] + gaussian_log(k["e"], v["s"])).alias("ll")),
                F.struct(c["m"].alias("m"), d["p"].alias("p"), s["ll"].alias("ll")),
            ),
        )

    return step


def kalman_2d(a: Sequence[Sequence[float]], q: Sequence[Sequence[float]], r: float) -> Callable[[Column, Column], Column]:
    """Two states of which the first is observed: x1, x2, p11, p12, p22, ll."""
    (a11, a12), (a21, a22) = a
    (q11, q12), (_, q22) = q

    def step(s: Column, y: Column) -> Column:
        p11, p12, p22 = s["p11"], s["p12"], s["p22"]
        names = ("x1", "x2", "p11", "p12", "p22", "ll")

        def out(*cols: Column) -> Column:
            return F.struct(*[c.alias(n) for c, n in zip(cols, names, strict=True)])

        return lets(
            lambda: {
                "x1": a11 * s["x1"] + a12 * s["x2"],
                "x2": a21 * s["x1"] + a22 * s["x2"],
                "p11": a11 * a11 * p11 + 2 * a11 * a12 * p12 + a12 * a12 * p22 + q11,
                "p12": a11 * a21 * p11 + (a11 * a22 + a12 * a21) * p12 + a12 * a22 * p22 + q12,
                "p22": a21 * a21 * p11 + 2 * a21 * a22 * p12 + a22 * a22 * p22 + q22,
            },
            lambda f: {"s": f["p11"] + r, "e": y - f["x1"]},
            lambda f, g: {"k1": f["p11"] / g["s"], "k2": f["p12"] / g["s"]},
            end=lambda f, g, k: observed(
                y,
                out(f["x1"] + k["k1"] * g["e"], f["x2"] + k["k2"] * g["e"], (1 - k["k1"]) * f["p11"], (1 - k["k1"]) * f["p12"], f["p22"] - k["k2"] * f["p12"], s["ll"] + gaussian_log(g["e"], g["s"])),
                out(f["x1"], f["x2"], f["p11"], f["p12"], f["p22"], s["ll"]),
            ),
        )

    return step


SMOOTHED = "struct<t:int,ms:double,ps:double,gain:double>"


def smooth_states(filtered: DataFrame, f: Callable[[Column], Column], slope: Callable[[Column], Column], q: float) -> DataFrame:
    """series_id, t, ms, ps, gain: the backward fold over filtered states (series_id, states with m and p), linear or extended by f and its slope."""
    numbered = F.transform("states", lambda s, i: F.struct((i + 1).cast("int").alias("t"), s["m"].alias("m"), s["p"].alias("p")))
    return _smoothed(filtered.where(F.size("states") > 0).select("series_id", F.reverse(numbered).alias("back")), f, slope, q)


def smooth_1d(filtered: DataFrame, f: Callable[[Column], Column], slope: Callable[[Column], Column], q: float) -> DataFrame:
    """smooth_states of rows (series_id, t, m, p)."""
    return _smoothed(filtered.groupBy("series_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("t", "m", "p")))).alias("back")), f, slope, q)


def _smoothed(arrays: DataFrame, f: Callable[[Column], Column], slope: Callable[[Column], Column], q: float) -> DataFrame:
    first = F.element_at("back", 1)
    start = F.struct(first["t"].alias("t"), first["m"].alias("ms"), first["p"].alias("ps"), F.lit(0.0).alias("gain"))

    def step(s: Column, x: Column) -> Column:
        def close(a: Column, b: Column, g: Column) -> Column:
            return F.struct(x["t"].alias("t"), (x["m"] + g["g"] * (s["ms"] - a["m"])).alias("ms"), (x["p"] + g["g"] * g["g"] * (s["ps"] - b["p"])).alias("ps"), g["g"].alias("gain")).cast(SMOOTHED)

        return lets(lambda: {"m": f(x["m"]), "j": slope(x["m"])}, lambda a: {"p": a["j"] * a["j"] * x["p"] + q}, lambda a, b: {"g": x["p"] * a["j"] / b["p"]}, end=close)

    out = F.concat(F.array(start.cast(SMOOTHED)), folded(F.slice("back", F.lit(2), F.size("back")), start, SMOOTHED, step))
    return arrays.select("series_id", F.inline(out))
