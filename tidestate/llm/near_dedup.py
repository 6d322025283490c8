"""MinHash near-dedup: universal hash minima, banding, signature verification, exact links, components.

A document's set is its distinct shingles (64-bit hashes of k words after lower-casing A-Z). Documents
of one set are one class, whose least doc_id stands for it. Of each set, HASHES minima of universal
hashes are taken, in bands of ROWS; two sets of similarity 0.8 miss all bands with a chance of 1.3e-7.

Links are found without making the pairs of a bucket (the classes that agree in a band):

1. Each bucket's least member is compared with its other members. Pairs whose signatures (a byte of
   each minimum) agree too little, with a chance below 1e-7 at similarity 0.8, are dropped; the
   others are confirmed on full sets. Their components come from large-star and small-star.
2. In buckets that still hold several components, members outside the bucket's largest component are compared by signature with all members of other
   components; what agrees makes families, and in each family full sets are compared alike, each document outside the
   largest component with all others of other components, through an index of the family's shingles. Families and buckets larger than a
   task's share are dealt out in blocks.

So every link between documents that share a band is confirmed or refuted, or lies within a
component already, and no pair is written that isn't a candidate of step 1 or a link.

Defined results. Null or wordless texts have empty sets and are linked with nothing. A text of fewer
than k words is one shingle. Repeated rows are in one class; rows that share a doc_id but not the text are one node.
A null doc_id is linked with nothing: its component is null and it is not kept. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import released, stored
from .components import components

ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
#: Share of equal signature bytes below which a pair is dropped: 0.8 less 5.3 standard deviations.
SIGNATURE_LEAST = 0.65
#: Members of a bucket or family that one task compares.
BLOCK = 512
#: Ids of candidates up to which they are broadcast to fetch texts; beyond, texts and ids are shuffled.
BROADCAST_IDS = 1_000_000
_seed = np.random.default_rng(20240229)
MULTIPLIERS = _seed.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, and where each row's begin (n + 1)."""
    w = K.Words(data, offsets, K.NON_SPACE, K.LOWER)
    h = w.hashes()
    starts = K.window_starts(w.row_at, k)
    key, row = K.window_hash(h, k)[starts] if len(starts) else np.zeros(0, np.uint64), np.searchsorted(w.row_at, starts, "right") - 1
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.array([K.window_hash(h[w.row_at[r] : w.row_at[r + 1]], int(w.count[r]))[0] for r in short], np.uint64)
        key, row = np.concatenate([key, whole]), np.concatenate([row, short])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(offsets)))


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, (HASHES, n)."""
    x = (sets >> K.U64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(at) - 1), np.uint32)
    n = len(at) - 1
    a = 0
    while a < n:  # some ten thousand shingles at a time stay in the cache
        b = max(a + 1, min(n, int(np.searchsorted(at, at[a] + 16384, "right")) - 1))
        part, begin = x[at[a] : at[b]], at[a:b] - at[a]
        buffer = np.empty_like(part)
        for i in range(HASHES):
            np.multiply(part, MULTIPLIERS[i], out=buffer)
            np.add(buffer, OFFSETS[i], out=buffer)
            out[i, a:b] = np.minimum.reduceat(buffer, begin)
        a = b
    return out


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands binary, signature binary"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Of each document (doc_id, text): the set's size and 128-bit digest, band hashes (BANDS longs) and signature (HASHES bytes); null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                cols = [np.zeros(b - a, np.int64) for _ in range(2)]
                bands, signature = np.full(b - a, None, object), np.full(b - a, None, object)
                if len(full):
                    begin = np.append(at[full], at[-1])
                    digest = b"".join(hashlib.blake2b(sets[i:j].tobytes(), digest_size=16).digest() for i, j in itertools.pairwise(begin.tolist()))
                    cols[0][full], cols[1][full] = np.frombuffer(digest, np.int64).reshape(-1, 2).T
                    m = minima(sets, begin)
                    band = np.empty((len(full), BANDS), np.uint64)
                    for j in range(BANDS):
                        h = np.full(len(full), j + 1, np.uint64)
                        for i in range(j * ROWS, (j + 1) * ROWS):
                            h = K.mix(h * K.U64(0x9E3779B97F4A7C15) + m[i])
                        band[:, j] = h
                    tail = np.ascontiguousarray((m.T >> np.uint32(13)).astype(np.uint8))
                    bands[full] = [r.tobytes() for r in band]
                    signature[full] = [r.tobytes() for r in tail]
                none = size == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), *(pa.array(c, mask=none) for c in cols), pa.array(bands, pa.binary()), pa.array(signature, pa.binary())], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), SIGNED)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """bucket, node: a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, _ = K.buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    return classes.select("node", "bands").mapInArrow(released(run), "bucket long, node long")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (hub, node) whose signatures agree in SIGNATURE_LEAST of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(K.buffers(b.column(i))[0].tobytes(), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            yield b.select(["hub", "node"]).filter(pa.array((x == y).mean(1) >= SIGNATURE_LEAST))

    s = classes.select("node", "signature")
    both = pairs.join(s.withColumnRenamed("signature", "s1"), "node").join(s.select(F.col("node").alias("hub"), F.col("signature").alias("s2")), "hub")
    return both.select("hub", "node", "s1", "s2").mapInArrow(released(run), "hub long, node long")


def with_sets(rows: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """rows (node, ...) with shingles, the node's set as bytes. They are written first, as they are read twice."""
    rows = stored(rows, "near-tasks")
    ids = stored(rows.select(F.col("node").alias("doc_id")).distinct(), "near-ids")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        d = d.join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["node", "shingles"])

    return rows.join(d.mapInArrow(released(run), "node long, shingles binary"), "node")


def dealt(rows: DataFrame, size: int) -> DataFrame:
    """Tasks of comparison. rows: grp, node, component; result: task, node, component, left (to be compared with the task's others).

    In each grp, members outside its largest component are compared with all members, in blocks of about `size`.
    """
    per = rows.groupBy("grp", "component").agg(F.count("*").alias("n"))
    top = per.groupBy("grp").agg(F.max(F.struct("n", F.col("component").alias("component"))).alias("top"), F.sum("n").alias("n"), F.count("*").alias("several"))
    top = top.where("several > 1 and n > 1").select("grp", F.col("top.component").alias("main"), F.ceil(F.col("n") / size).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / size).cast("int").alias("left_blocks"))
    # written first, so that the join below deals out rows and tops alike and a large group's rows can be split
    r = rows.join(stored(top, "near-top"), "grp")
    here = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("left_blocks")).cast("int")
    task = lambda i, b: F.struct(F.col("grp"), i.alias("i"), b.alias("b"))
    # in one pass, as a union would read and join the rows twice
    all_left = F.sequence(F.lit(0), F.col("left_blocks") - 1)
    all_blocks = F.when(F.col("component") != F.col("main"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    right = F.transform(all_left, lambda i: F.struct(F.lit(False).alias("left"), task(i, here).alias("task")))
    left = F.transform(all_blocks, lambda b: F.struct(F.lit(True).alias("left"), task(mine, b).alias("task")))
    return r.select("node", "component", F.inline(F.concat(right, left)))


class Sets:
    """Union-find over the components of a task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def by_signature(task: pd.DataFrame) -> pd.DataFrame:
    """The members of a task whose signature agrees with that of a member of another component: node, component, and the component that stands for all that meet here."""
    s = np.frombuffer(b"".join(task["signature"]), np.uint8).reshape(-1, HASHES)
    node, comp, left = task["node"].to_numpy(), task["component"].to_numpy(), task["left"].to_numpy()
    active, sets = left & False, Sets()
    for i in np.flatnonzero(left):
        meets = (comp != comp[i]) & ((s == s[i]).mean(1) >= SIGNATURE_LEAST)
        if meets.any():
            active |= meets
            active[i] = True
            for c in np.unique(comp[meets]):
                sets.join(int(comp[i]), int(c))
    at = np.flatnonzero(active)
    return pd.DataFrame({"node": node[at], "component": comp[at], "meeting": np.array([sets.find(int(c)) for c in comp[at]], np.int64)})


def exact(percent: int) -> object:
    """A function of a task (node, component, left, shingles) that gives links between components: u, v."""

    def run(task: pd.DataFrame) -> pd.DataFrame:
        node, comp, left = task["node"].to_numpy(), task["component"].to_numpy(), task["left"].to_numpy()
        each = [np.frombuffer(x, np.uint64) for x in task["shingles"]]
        size = np.array([len(x) for x in each], np.int64)
        values, token = np.unique(np.concatenate(each), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(each)), size)
        order = np.argsort(token, kind="stable")
        begin = np.searchsorted(token[order], np.arange(len(values) + 1))
        rows = row[order]
        out, sets = [], Sets()
        for i in np.flatnonzero(left):
            t = token[at[i] : at[i + 1]]
            n = begin[t + 1] - begin[t]
            pick = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(rows[pick], minlength=len(each))
            union = size[i] + size - common
            for j in np.flatnonzero((100 * common >= percent * union) & (comp != comp[i])):
                if sets.join(int(comp[i]), int(comp[j])):
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component of all nodes (node), given links."""
    c = components(edges)
    return nodes.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (node, component) with the components that links join made one; only components and links are searched anew."""
    ends = (state.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    c = components(links.join(next(ends), "u").join(next(ends), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    return state.join(c.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def further(rows: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between components that meet in buckets. rows: grp, node, component of the members of these buckets."""
    tasks = dealt(rows, BLOCK).join(classes.select("node", "signature"), "node")
    active = stored(tasks.groupBy("task").applyInPandas(by_signature, "node long, component long, meeting long"), "near-active")
    families = components(active.select(F.col("component").alias("u"), F.col("meeting").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("grp"))
    members = active.select("node", "component").distinct().join(families, "component")
    more = with_sets(dealt(members.select("grp", "node", "component"), BLOCK), docs, k).groupBy("task").applyInPandas(exact(percent), "u long, v long")
    return stored(more, "near-more")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (it is the least doc_id of its component) of each document (doc_id, text).

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets.
    """
    all_docs = stored(signed(docs, k), "near-signed")
    classes = all_docs.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("m"))
    classes = stored(classes.select("d1", "d2", F.col("m.doc_id").alias("node"), F.col("m.bands").alias("bands"), F.col("m.signature").alias("signature")), "near-classes")
    nodes = classes.select("node").distinct()
    buckets = bucket_rows(classes)

    # 1. the least of each bucket with the others
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("bucket", "hub")
    pairs = buckets.join(hubs, "bucket").where("node <> hub").select("hub", "node").distinct()
    pairs = stored(agreeing(pairs, classes), "near-pairs")
    n_members = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    p = pairs.join(n_members, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"))
    task = F.struct(F.col("hub").alias("grp"), F.lit(0).alias("i"), F.col("b").alias("b")).alias("task")
    stars = p.select(task, "node", F.col("node").alias("component"), F.lit(False).alias("left")).unionByName(p.select(task, F.col("hub").alias("node"), F.col("hub").alias("component"), F.lit(True).alias("left")).distinct())
    links = stored(with_sets(stars, docs, k).groupBy("task").applyInPandas(exact(percent), "u long, v long"), "near-links")
    state = stored(linked(nodes, links), "near-state")

    # 2. buckets of several components
    b = buckets.join(state, "node")
    open_ = b.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("bucket")
    rows = stored(b.join(open_, "bucket").select(F.col("bucket").alias("grp"), "node", "component"), "near-open")
    if not rows.isEmpty():
        state = merged(state, further(rows, classes, docs, k, percent))
    # by class first: what then meets at a class of many copies is a plain join, whose large partitions can be split
    of_class = classes.select("d1", "d2", "node").join(state, "node").select("d1", "d2", "component")
    within = F.col("d1").isNotNull() & F.col("doc_id").isNotNull()
    done = all_docs.where(within).join(of_class, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # empty sets and null doc_ids have no class: they stay out of the join, where they all would be one key
    done = done.unionByName(all_docs.where(~within).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
