"""The Kalman filter of a scalar random walk or autoregression, parallel in time.

A long series is cut into blocks of time; no task holds more than a block. Filtering is associative over
elements (a, b, c, e, j) (Sarkka and Garcia-Fernandez, "Temporal parallelization of Bayesian smoothers", 2021): a fold makes
one element of each block, a fold over a series' blocks gives the state at each block's start, and a scan
within each block the filtered states. A series that holds a third of all rows so spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded, gaussian_log, let, lets, observed

ELEMENT = "struct<a:double,b:double,c:double,e:double,j:double>"


def element(y: Column, a: float, q: float, h: float, r: float) -> Column:
    """The element of one step; of a step without observation for a null y."""
    s = h * h * q + r
    k = q * h / s
    seen = F.struct(F.lit((1 - k * h) * a).alias("a"), (k * y).alias("b"), F.lit((1 - k * h) * q).alias("c"), (a * h / s * y).alias("e"), F.lit(a * a * h * h / s).alias("j"))
    none = F.struct(F.lit(float(a)).alias("a"), F.lit(0.0).alias("b"), F.lit(float(q)).alias("c"), F.lit(0.0).alias("e"), F.lit(0.0).alias("j"))
    return observed(y, seen.cast(ELEMENT), none.cast(ELEMENT))


def combined(x: Column, z: Column) -> Column:
    """The element of x's steps followed by z's."""

    def close(g: Column) -> Column:
        return F.struct(
            (z["a"] * x["a"] * g["g"]).alias("a"),
            (z["a"] * g["g"] * (x["b"] + x["c"] * z["e"]) + z["b"]).alias("b"),
            (z["a"] * z["a"] * g["g"] * x["c"] + z["c"]).alias("c"),
            (x["a"] * g["g"] * (z["e"] - z["j"] * x["b"]) + x["e"]).alias("e"),
            (x["a"] * x["a"] * g["g"] * z["j"] + x["j"]).alias("j"),
        ).cast(ELEMENT)

    return let({"g": 1 / (1 + x["c"] * z["j"])}, close)


def kalman_blocks(df: DataFrame, key: str, order: Sequence[str], value: str, block: Column, a: float = 1.0, q: float = 0.1, h: float = 1.0, r: float = 4.0, m0: float = 0.0, p0: float = 1.0) -> DataFrame:
    """series_id, t, y, m, p and ll (running log likelihood). block has to grow with the order columns and bound the rows of a block."""
    item = F.struct(*order, F.col(value).cast("double").alias("y"))
    cut = df.groupBy(F.col(key).alias("series_id"), block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["y"]).alias("ys"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("e"), F.lit(0.0).alias("j")).cast(ELEMENT)
    # a block's element, one row a block
    parts = cut.select("series_id", "block", F.size("ys").alias("n"), F.aggregate("ys", none, lambda acc, y: let({"z": element(y, a, q, h, r)}, lambda b: combined(acc, b["z"]))).alias("element"))
    before = Window.partitionBy("series_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.struct(F.lit(0.0).alias("a"), F.lit(float(m0)).alias("b"), F.lit(float(p0)).alias("c"), F.lit(0.0).alias("e"), F.lit(0.0).alias("j")).cast(ELEMENT)
    # the states at the starts: a scan over a series' blocks
    rows = parts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("block", "n", "element"))).alias("blocks"))
    # of each block the state at its start: those after all blocks but the last, and the prior before them
    after = folded(F.slice("blocks", F.lit(1), F.size("blocks") - 1), prior, ELEMENT, lambda s, b: combined(s, b["element"]))
    scanned = rows.select("series_id", "blocks", F.concat(F.array(prior), after).alias("starts"))
    starts = scanned.select("series_id", F.inline(F.arrays_zip("blocks", "starts"))).select("series_id", F.col("blocks.block").alias("block"), F.col("blocks.n").alias("n"), F.col("starts.b").alias("m"), F.col("starts.c").alias("p"))
    starts = starts.withColumn("t0", F.coalesce(F.sum("n").over(before), F.lit(0)))

    kind = "struct<m:double,p:double,ll:double>"

    def step(s: Column, y: Column) -> Column:
        return lets(
            lambda: {"m": a * s["m"], "p": a * a * s["p"] + q},
            lambda f: {"e": y - h * f["m"], "s": h * h * f["p"] + r},
            end=lambda f, g: observed(y, F.struct((f["m"] + f["p"] * h / g["s"] * g["e"]).alias("m"), (f["p"] - f["p"] * h * f["p"] * h / g["s"]).alias("p"), (s["ll"] + gaussian_log(g["e"], g["s"])).alias("ll")), F.struct(f["m"].alias("m"), f["p"].alias("p"), s["ll"].alias("ll"))).cast(kind),
        )

    both = cut.join(starts, ["series_id", "block"])
    states = both.select("series_id", "block", "t0", "ys", folded(F.col("ys"), F.struct("m", "p", F.lit(0.0).alias("ll")), kind, step).alias("states"))
    ll0 = F.coalesce(F.sum(F.element_at("states", -1)["ll"]).over(before), F.lit(0.0))
    rows = states.withColumn("ll0", ll0).select("series_id", "t0", "ll0", F.posexplode(F.arrays_zip("ys", "states")).alias("i", "z"))
    return rows.select("series_id", (F.col("t0") + F.col("i") + 1).cast("int").alias("t"), F.col("z.ys").alias("y"), F.col("z.states.m").alias("m"), F.col("z.states.p").alias("p"), (F.col("ll0") + F.col("z.states.ll")).alias("ll"))
