"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate (how often it is taken) between 0 and `most`. Of all rates whose tokens add up to the target of each
source, those of least relative entropy to the corpus (rate 1 for all) are taken: with a multiplier l for each source's token
constraint, a document of `size` tokens has the rate min(most, exp(l * size)), an exponential tilt by its tokens. The dual is convex and
separates by source: sum(phi(l * size)) - l * target over its documents, phi being exp, continued as a line from log(most) on. Newton steps,
held within a bracket, find l; a source that does not converge raises an error. Gradient and curvature are sums over documents of
functions of their size alone, so documents are first counted by (source, size), in one aggregation over all of them, and the steps run in
executors' tasks, a source each, over its distinct sizes (no more than the root of twice its tokens, as sizes are whole numbers).

Rates become copies from the longest documents of a source to
the shortest: each size's documents share the copies that bring the words taken so far nearest to
the words due, within the whole numbers around the rate and as far as shorter documents can make good what remains. A source so
ends within about its shortest documents' size of its target. Among documents of one size the copies are dealt evenly.

Ranks are counted in two levels, over (source, size, salt) groups and then within a group, so
that a source that holds most rows is spread over all tasks.

Defined results. A null text has size 0, is taken 0 times and gets 0 copies; so does any document
without words. A null source is a source of its own, last in order. Repeated rows are documents
of their own, as each row is. An empty table gives an empty result. Other columns are ignored
(clashing names included): only the columns named in `mix` are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, stored

#: No document is taken more often.
MOST = 3
#: Newton ends at this relative error of a source's tokens; after STEPS without it an error is raised.
TOLERANCE = 1e-10
STEPS = 200
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with the target of each.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all tokens; a target stops at
    most * source_size and the excess is shared anew by weight. Closed form: in order of
    most * source_size / weight, the first k sources stop, for the least k at which the share left for
    each unit of weight is no more than the next source's ratio.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    rank = F.row_number().over(order) - 1
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("left_tokens", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("share", F.col("left_tokens") / F.col("left_weight"))
    first = F.first(F.when(F.col("share") <= F.col("ratio"), F.col("share")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("level", F.coalesce(first, F.lit(0.0)))
    return w.select("source", "source_size", "weight", F.when(F.col("level") * F.col("weight") >= most * F.col("source_size"), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def newton(size: np.ndarray, n: np.ndarray, target: float, most: float = MOST) -> float:
    """The multiplier at which sum(n * size * min(most, exp(l * size))) is the target; infinite where only `most` copies of all reach it.

    size, n: distinct sizes in order and how many documents have each. Sizes are scaled by their mean, so that steps are of about 1.
    """
    s, n = size.astype(float), n.astype(float)
    total = float((n * s).sum())
    if total <= 0 or target <= 0:
        return -math.inf
    if target >= most * total * (1 - 1e-12):
        return math.inf
    scale = total / n.sum()
    x, top = s / scale, math.log(most)
    low, high, l = -math.inf, math.inf, 0.0
    for _ in range(STEPS):
        u = l * x
        tilted = np.exp(np.minimum(u, top)) * n * s
        off = float(tilted.sum()) - target
        if abs(off) <= TOLERANCE * target:
            return l / scale
        low, high = (l, high) if off < 0 else (low, l)
        curve = float((tilted * x)[u < top].sum())
        step = l - off / curve if curve > 0 else math.inf
        if not low < step < high:  # outside what is known: halve, or go on from the known end
            step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else 2 * l + (1.0 if off < 0 else -1.0)
        l = step
        if math.isfinite(high - low) and high - low <= 1e-15 * max(abs(low), abs(high)):
            return l / scale
    raise RuntimeError("entropy balancing did not converge")


def rate_of(size: np.ndarray, l: float, most: float = MOST) -> np.ndarray:
    """min(most, exp(l * size)); 0 for documents without words."""
    if math.isinf(l):
        return np.where(size > 0, float(most) if l > 0 else 0.0, 0.0)
    return np.where(size > 0, np.exp(np.minimum(l * size, math.log(most))), 0.0)


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The copies that the documents of each size share, from the longest to the shortest.

    Each size's copies lie within the whole numbers around its rate and bring the words taken nearest to the words due, as far as
    the shorter documents can still make good what is left.
    """
    order = np.argsort(-size, kind="stable")
    s, k, r = size[order], n[order], rate[order]
    least, most = np.floor(r + 1e-9) * k, np.ceil(r - 1e-9) * k
    # words by which what comes after may go below and beyond its due
    below = np.append(np.cumsum(((r * k - least) * s)[::-1])[::-1][1:], 0.0)
    beyond = np.append(np.cumsum(((most - r * k) * s)[::-1])[::-1][1:], 0.0)
    due, out = 0.0, np.zeros(len(size), np.int64)
    for i, (at, each, low, high, words_due) in enumerate(zip(order.tolist(), s.tolist(), least.tolist(), most.tolist(), (r * k * s).tolist(), strict=True)):
        due += words_due
        if each:
            c, first, last = round(due / each), math.ceil((due - beyond[i]) / each), math.floor((due + below[i]) / each)
            c = min(max(c, first), last) if first <= last else c
            out[at] = min(max(c, int(low)), int(high))
            due -= int(out[at]) * each
    return out


PLAN = "source string, size long, source_size long, target double, rate double, group_n long, group_copies long"


def balanced(most: int) -> Callable:
    """A function of one source's rows (source, size, n, source_size, target) that gives their plan."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        rate = rate_of(size, newton(size, n, float(group["target"].iloc[0]), most), most)
        return group.assign(rate=rate, group_n=n, group_copies=rounded(size, n, rate))[[c.split()[0] for c in PLAN.split(", ")]]

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", goal: DataFrame | None = None, most: int = MOST, order: list[Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every document.

    goal: source, source_size, target, if not that of `targets`. order: by what copies are dealt among documents of
    one size, if not by doc_id.
    """
    spark = docs.sparkSession
    keys = {f"key{i}": c for i, c in enumerate(order or [])}
    d = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *(c.alias(k) for k, c in keys.items())), "mix-sizes")
    by = list(keys) or ["doc_id"]
    # rows of a group that is ranked in one task: some thousands of millions of equal documents would still be split
    salts = max(16, bytes_of(d) // (64 << 20))
    d = d.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    groups = stored(d.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-groups")
    sizes = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    if goal is None:
        goal = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most)
    r, q = sizes.alias("r"), stored(goal.select("source", "source_size", "target"), "mix-goal").alias("q")
    plan = r.join(q, F.expr("r.source <=> q.source")).select("r.source", "r.size", "r.n", "q.source_size", "q.target")
    plan = stored(plan.groupBy("source").applyInPandas(balanced(most), PLAN), "mix-plan")
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    r, q = groups.withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("r"), plan.alias("q")
    ranked = r.join(q, F.expr("r.source <=> q.source and r.size = q.size")).select("q.*", "r.salt", "r.rank0")

    inside = Window.partitionBy("source", "size", "salt").orderBy(*by)
    d = d.withColumn("i", F.row_number().over(inside))
    d, k = d.alias("d"), ranked.alias("k")
    out = d.join(k, F.expr("d.source <=> k.source and d.size = k.size and d.salt = k.salt"), "left")
    copies = F.expr("((k.rank0 + d.i) * k.group_copies) div k.group_n - ((k.rank0 + d.i - 1) * k.group_copies) div k.group_n")
    return out.select("d.doc_id", "d.source", "d.size", "k.source_size", "k.target", "k.rate", copies.cast("long").alias("copies"))
