"""Secret scans in DataFrame operations only: base patterns, and character Markov models.

Two first-order Markov chains over the characters of ALPHABET are counted from labelled samples,
one of random strings and one of ordinary identifiers and prose words. A candidate (a run of 20
or more of ALPHABET) is a secret if its log-likelihood ratio for each transition, in thousandths of a nat, is
at least MARGIN. Base patterns (kinds assign, access, hex) always stay; spans of the kind markov are added
where they don't overlap a base span.

Positions are found without a row for each match: a text split at a pattern gives the gaps
between its matches, whose lengths add up to the starts. Running sums and greatest ends go over arrays in
slices (`scanned`), so that work grows in proportion to the matches, and to a candidate's length.

Defined results. A null text is empty; an empty text has no spans. Repeated rows give repeated
rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns and the least lengths of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: Runs shorter than these would be dropped; the patterns find the same runs as access `AKIA[A-Z0-9]+` and hex `[0-9a-f]+` do.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Least mean log-likelihood ratio of a transition, in thousandths of a nat.
MARGIN = 300
#: Strings of each labelled kind that the chains are counted from.
SAMPLES = 4000
#: Stems of ordinary identifiers.
STEMS = """account action address after amount array async author background balance before block border branch bucket buffer build button cache
cancel canvas chain change channel check child class clean click client close cluster code column commit common compare component config connect
constant container content context control copy count create current customer data database date debug default delete depth detail device direct
display document domain download drive driver editor element email enable engine entry error event example export extension factory feature field
file filter final first float folder format frame function gateway generate global graph group handler header height helper history host image
import index info initial input instance integer interface internal item iterator job join key label language last layer layout length level
library limit line link list listener load local location logger login loop manager map market master matrix maximum memory menu message method
metric minimum model module monitor name network node number object offset option order origin output owner package page panel parent parser""".split()


def labelled(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """The samples: text, random (1 or 0). Random strings are digests in several spellings; identifiers join stems in several styles."""
    ids = spark.range(n)
    digest = F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256))
    hexed, coded = F.lower(F.hex(digest)), F.base64(digest)
    size = F.lit(20) + F.col("id") % 20
    strings = ids.select(F.explode(F.array(F.substring(coded, F.lit(1), size), F.substring(hexed, F.lit(1), size), F.substring(F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")), F.lit(1), size))).alias("text"), F.lit(1).alias("random"))
    stems = F.array(*map(F.lit, STEMS))

    def stem(k: int) -> Column:
        return F.element_at(stems, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(STEMS))) + 1).cast("int"))

    parts = [stem(k) for k in range(3)]
    styles = [F.concat_ws("_", *parts), F.concat_ws("-", *parts), F.concat(parts[0], F.initcap(parts[1]), F.initcap(parts[2])), F.upper(F.concat_ws("_", *parts)), F.concat(*parts), F.concat_ws("/", *parts), F.concat(parts[0], F.lit("_"), parts[1], (F.col("id") % 100).cast("string"))]
    return strings.unionByName(ids.select(F.explode(F.array(*styles)).alias("text"), F.lit(0).alias("random")))


def prose(docs: DataFrame, labels: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Words of at most n // 4 documents of quality 1 (those of the least hash), as ordinary strings: text, random 0."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n // 4)
    words = docs.join(F.broadcast(good), "doc_id").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![^\s])[A-Za-z]{4,}"), F.lit(0))).alias("text"))
    return words.select("text", F.lit(0).alias("random"))


def code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c) - 1


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios (thousandths of a nat) of all transitions, row by row; len(ALPHABET)**2 of them."""
    n = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = samples.where(F.length("text") > 1).select("text", "random", at.alias("i")).select("random", code(F.expr("substring(text, i, 1)")).alias("a"), code(F.expr("substring(text, i + 1, 1)")).alias("b"))
    got = pairs.where("a >= 0 and b >= 0").groupBy("random", "a", "b").count().collect()  # at most 2 * len(ALPHABET)**2 rows
    count = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for r in got:
        count[r["random"]][r["a"]][r["b"]] += r["count"]
    total = [[sum(row) for row in m] for m in count]
    return [round(1000 * (math.log(count[1][a][b] / total[1][a]) - math.log(count[0][a][b] / total[0][a]))) for a in range(n) for b in range(n)]


#: Elements of a slice.
SLICE = 64


def scanned(array: Column, zero: Column, kind: str, add: Callable, join: Callable, out: Callable) -> Column:
    """out(state before e, e) for each element e of array, the state being zero and then add(state, e).

    An array that grows by one in each step of a fold is copied in each step; so slices are folded first, each into one state (join
    adds the states of two neighbours), and each slice then starts from what all before it come to. kind: the type of the results.
    """
    empty = F.array().cast(f"array<{kind}>")

    def grown(acc: Column, state: Column, one: Column) -> Column:
        return F.struct(state.alias("now"), F.concat(acc["out"], F.array(one)).alias("out"))

    def whole(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(SLICE))
        return F.transform(F.array(F.transform(starts, lambda i: F.slice(a, i, F.lit(SLICE)))), ahead)[0]

    def ahead(slices: Column) -> Column:
        sums = F.transform(slices, lambda c: F.aggregate(c, zero, add))
        states = F.aggregate(sums, F.struct(zero.alias("now"), F.array().cast("array<int>").alias("out")), lambda acc, v: grown(acc, join(acc["now"], v), acc["now"]), lambda acc: acc["out"])
        each = F.zip_with(slices, states, lambda c, now: F.aggregate(c, F.struct(now.alias("now"), empty.alias("out")), lambda acc, e: grown(acc, add(acc["now"], e), out(acc["now"], e)), lambda acc: acc["out"]))
        return F.flatten(each)

    return F.transform(F.array(array), whole)[0]  # bound once


SPAN = "struct<start:int,end:int,rank:int,kind:string>"


def span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))


def matches(text: Column, pattern: str, kind: str, keep: Callable | None = None, extra: Column | None = None) -> Column:
    """array<struct<start, end, rank, kind>> of a pattern's matches, in order. keep is told of each match m and its extra x."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), (found if extra is None else extra).alias("x"))

    def one(at: Column, e: Column) -> Column:
        start = at + F.length(e["g"])
        new = span(start, start + F.length(e["m"]), kind)
        return new if keep is None else F.when(keep(e["m"], e["x"]), new)

    spans = scanned(zipped, F.lit(0), SPAN, lambda at, e: at + F.length(e["g"]) + F.length(e["m"]), lambda a, b: a + b, one)
    spans = spans if keep is None else F.filter(spans, lambda v: v.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap none of base."""
    event = lambda s, own: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, False)), F.transform(spans, lambda s: event(s, True))))
    kind = "struct<start:int,own:boolean,end:int>"
    # those that begin behind the last end of base so far; then, backwards, those that end before the next of base begins
    last = lambda now, e: F.when(e["own"], now).otherwise(F.greatest(now, e["end"]))
    ahead = lambda now, e: F.when(e["own"], now).otherwise(F.least(now, e["start"]))
    there = lambda v: v.isNotNull()
    events = F.filter(scanned(events, F.lit(0), kind, last, F.greatest, lambda now, e: F.when(~e["own"] | (e["start"] >= now), e)), there)
    events = F.filter(scanned(F.reverse(events), F.lit(1 << 30), kind, ahead, F.least, lambda now, e: F.when(e["own"] & (e["end"] <= now), e)), there)
    return F.transform(F.reverse(events), lambda e: span(e["start"], e["end"], "markov"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[int], margin: int = MARGIN) -> DataFrame:
    """doc_id, base and added: arrays of spans (start, end in code points, end exclusive; rank and name of the kind) of each document."""
    n = len(ALPHABET)
    text = F.coalesce("text", F.lit(""))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def odd(m: Column, _: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            at = code(c)
            more = F.when(acc["at"] >= 0, F.element_at(table, (acc["at"] * n + at + 1).cast("int"))).otherwise(0)
            return F.struct(at.alias("at"), (acc["sum"] + more).alias("sum"))

        total = F.aggregate(F.split(m, ""), F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("sum")), step, lambda acc: acc["sum"])
        return total >= F.lit(margin).cast("long") * (F.length(m) - 1)

    assign = matches(text, ASSIGN, "assign", lambda _, x: F.length(x) >= ASSIGN_LEAST, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    found = docs.select("doc_id", F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")).alias("base"), matches(text, CANDIDATE, "markov", odd).alias("markov"))
    return found.select("doc_id", "base", F.when((F.size("markov") > 0) & (F.size("base") > 0), apart(F.col("markov"), F.col("base"))).otherwise(F.col("markov")).alias("added"))
