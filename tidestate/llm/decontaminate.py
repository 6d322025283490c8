"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. An
item's windows are its runs of 13 words, or all of its words if they are fewer. A window is the
set of its shingles (runs of up to three words, with their offsets); containment has to be whole,
so the necessary prefix is the one shingle that comes first in the order of rarity over all
documents. Documents are probed for these prefixes; each match proposes a start, is bounded by
the document's first and last word, and is verified word for word over the whole window.

The index of the windows is broadcast in blocks of items of about BLOCK characters (an item is
never cut). One block is probed in one pass. Of several, each pass writes what it finds, by the text's digest, to the shared folder, and
one join brings all of it to the documents: the plan does not grow with the benchmark, and there is no other limit on it.

Defined results. Null texts have no words: such documents are clean, such items have no windows,
and items of null id are left out. Repeated rows give repeated rows; repeated items count once.
An empty benchmark leaves all documents clean. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import released, scratch

WINDOW = 13
SHINGLE = 3
#: Characters of items whose windows are broadcast at once.
BLOCK = 4_000_000
SPANS = "array<struct<start: int, end: int>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


@dataclass
class Index:
    """The distinct windows of a block of items. A window is a run of words of the block's text, in which words are joined by one byte."""

    text: bytes
    begin: np.ndarray  # of each window: its bytes, its number of words, a hash of them
    end: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    names: list[str]
    owner_at: np.ndarray  # window i's items are names[owners[owner_at[i]:owner_at[i + 1]]]
    owners: np.ndarray
    shingles: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> windows, and the hashes of each one's shingles by offset
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None  # length -> hashes, CSR ends, windows, offsets


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Index:
    """The index of items (name, text)."""
    raw = pa.array([t or "" for _, t in items], pa.string())
    data, offsets = K.buffers(raw)
    w = K.Words(data, offsets, K.WORDLIKE, K.LOWER)
    text, at = K.gather(w.data, w.start, w.end, 32)
    h = w.hashes()
    starts, sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(1, window + 1):
        s = K.window_starts(w.row_at, k)
        if k < window:  # items of fewer words are one window
            s = w.row_at[:-1][w.count == k]
        starts.append(s)
        sizes.append(np.full(len(s), k))
        hashes.append(K.window_hash(h, k)[s])
    start, size, hash_ = (np.concatenate(x) for x in (starts, sizes, hashes))
    item = np.searchsorted(w.row_at, start, "right") - 1
    # alike ones become one; windows that merely share a hash stay apart
    order = np.lexsort((item, hash_, size))
    new = np.ones(len(order), bool)
    new[1:] = (hash_[order][1:] != hash_[order][:-1]) | (size[order][1:] != size[order][:-1])
    body, begin, end = text.tobytes(), at[start], at[start + size] - 1
    for i in np.flatnonzero(~new).tolist():
        x, y = order[i], order[i - 1]
        new[i] = body[begin[x] : end[x]] != body[begin[y] : end[y]]
    which = np.cumsum(new) - 1
    one = order[new]
    pair = np.unique(np.stack([which, item[order]], 1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
    shingles = {}
    for s in sorted({min(SHINGLE, k) for k in np.unique(size[one]).tolist()}):
        for k in np.unique(size[one]).tolist():
            if min(SHINGLE, k) == s:
                at_k = np.flatnonzero(size[one] == k)
                shingles[k] = (at_k, K.window_hash(h, s)[start[one][at_k][:, None] + np.arange(k - s + 1)])
    names = [n for n, _ in items]
    return Index(body, begin[one], end[one], size[one], hash_[one], names, np.searchsorted(pair[:, 0], np.arange(len(one) + 1)), pair[:, 1], shingles)


class Lookup:
    """Which of many hashes belong to a small set: a table of flags first, then a search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.hashes >> K.U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h and their places in the set."""
        at = np.flatnonzero(self.flags[(h >> K.U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == h[at]
        return at[ok], place[ok]


def rarity(docs: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The index's shingles, in order, and how often each starts in docs."""
    by = {s: np.unique(np.concatenate([g.ravel() for k, (_, g) in index.shingles.items() if min(SHINGLE, k) == s])) for s in {min(SHINGLE, k) for k in index.shingles}}
    cast = docs.sparkSession.sparkContext.broadcast(by)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = {s: Lookup(v) for s, v in cast.value.items()}
        total = {s: np.zeros(len(x.hashes), np.int64) for s, x in looks.items()}
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for a, b in K.chunks(offsets):
                w = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.WORDLIKE, K.LOWER)
                h = w.hashes()
                for s, x in looks.items():
                    _, place = x.find(K.window_hash(h, s))  # runs across two documents weigh little in an order
                    total[s] += np.bincount(place, minlength=len(x.hashes))
        for s, x in looks.items():
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes.view(np.int64)), pa.array(total[s])], ["h", "n"])

    # one row for each shingle of the block
    got = docs.select("text").mapInArrow(released(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def choose_prefixes(index: Index, seen: np.ndarray, times: np.ndarray) -> None:
    """The rarest shingle of each window becomes its prefix; of equally rare ones, that of the least hash."""
    parts: dict[int, list] = {}
    for k, (window, hashes) in index.shingles.items():
        n = np.zeros(hashes.shape, np.int64)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
            n = np.where(seen[at] == hashes, times[at], 0)
        rare = np.where(n == n.min(1, keepdims=True), hashes, np.uint64(2**64 - 1))
        offset = rare.argmin(1)
        parts.setdefault(min(SHINGLE, k), []).append((hashes[np.arange(len(offset)), offset], window, offset))
    index.prefix = {}
    for s, each in parts.items():
        h, window, offset = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.argsort(h, kind="stable")
        keys, at = np.unique(h[order], return_index=True)
        index.prefix[s] = (keys, np.append(at, len(order)), window[order], offset[order])
    index.shingles = {}


def occurrences(w: K.Words, index: Index, looks: dict[int, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """Start word and window of every occurrence of a window in the rows of w."""
    h = w.hashes()
    starts, windows = [], []
    for s, look in looks.items():
        _, ends, window, offset = index.prefix[s]
        at, place = look.find(K.window_hash(h, s))
        size = np.diff(ends)[place]
        pick = np.repeat(ends[:-1][place] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(place) else np.zeros(0, np.int64)
        starts.append(np.repeat(at, size) - offset[pick])
        windows.append(window[pick])
        if len(pick):
            # bounds: the window begins and ends within the document of its prefix
            row = np.searchsorted(w.row_at, np.repeat(at, size), "right") - 1
            ok = (starts[-1] >= w.row_at[row]) & (starts[-1] + index.size[windows[-1]] <= w.row_at[row + 1])
            starts[-1], windows[-1] = starts[-1][ok], windows[-1][ok]
    start, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, windows))
    if not len(start):
        return start, window
    ok, k = np.zeros(len(start), bool), index.size[window]
    for n in np.unique(k).tolist():
        at = np.flatnonzero(k == n)
        ok[at] = K.window_hash(h[start[at][:, None] + np.arange(n)], n)[:, 0] == index.hash[window[at]]
    start, window = start[ok], window[ok]
    raw = w.data.tobytes()
    ok = np.fromiter((b" ".join(raw[a:b] for a, b in zip(w.start[i : i + index.size[j]], w.end[i : i + index.size[j]], strict=True)) == index.text[index.begin[j] : index.end[j]] for i, j in zip(start, window, strict=True)), bool, len(start))
    return start[ok], window[ok]


def read_words(column: pa.Array) -> Iterator[tuple[int, int, K.Words]]:
    """Ranges of rows, and their words."""
    data, offsets = K.buffers(column)
    for a, b in K.chunks(offsets):
        yield a, b, K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.WORDLIKE, K.LOWER)


def found_in(w: K.Words, index: Index, looks: dict[int, Lookup]) -> tuple[list[set[str]], np.ndarray]:
    """Of each row the items with windows in it; and where runs of hit words begin (1 for each) and end (-1), by word."""
    start, window = occurrences(w, index, looks)
    row = np.searchsorted(w.row_at, start, "right") - 1
    items: list[set[str]] = [set() for _ in range(len(w.count))]
    for r, j in set(zip(row.tolist(), window.tolist(), strict=True)):
        items[r].update(index.names[o] for o in index.owners[index.owner_at[j] : index.owner_at[j + 1]])
    change = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + index.size[window], -1)
    return items, change


def summed(w: K.Words, items: list[set[str]], change: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """n_words, n_hit, items and spans of each row."""
    hit = np.cumsum(change[:-1]) > 0
    # maximal runs of hit words, cut at the rows' ends
    cut = np.zeros(len(hit) + 1, bool)
    cut[w.row_at] = True
    begin = np.flatnonzero(hit & (cut[:-1] | ~np.concatenate([[False], hit[:-1]])))
    end = np.flatnonzero(hit & (cut[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    of = np.searchsorted(w.row_at, begin, "right") - 1
    at, base = np.searchsorted(of, np.arange(len(items) + 1)).astype(np.int32), w.row_at[of]
    pairs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"])
    return pa.array(w.count), pa.array(K.per_row(hit, w.row_at)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(at), pairs)


NAMES = ["doc_id", "n_words", "n_hit", "items", "spans"]


def typed(docs: DataFrame, carry: tuple[str, ...]) -> str:
    return ", ".join([SCHEMA, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])


def looked_up(index: Index) -> dict[int, Lookup]:
    return {s: Lookup(p[0]) for s, p in index.prefix.items()}


def probe(docs: DataFrame, index: Index, carry: tuple[str, ...] = ()) -> DataFrame:
    """The result for docs (doc_id, text, carry) and one block."""
    cast = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, looks = cast.value, looked_up(cast.value)
        for batch in batches:
            for a, b, w in read_words(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *summed(w, *found_in(w, ix, looks)), *(part.column(x) for x in carry)], [*NAMES, *carry])

    return docs.mapInArrow(released(run), typed(docs, carry))


def hits(texts: DataFrame, index: Index) -> DataFrame:
    """digest, items and spans of the texts (digest, text) that have windows of the block."""
    cast = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, looks = cast.value, looked_up(cast.value)
        for batch in batches:
            for a, b, w in read_words(batch.column(1)):
                items, change = found_in(w, ix, looks)
                _, _, names, spans = summed(w, items, change)
                some = pa.array([bool(x) for x in items])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(some), names.filter(some), spans.filter(some)], ["digest", "items", "spans"])

    return texts.mapInArrow(released(run), f"digest string, items array<string>, spans {SPANS}")


def merged(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The result for docs (doc_id, text, items, spans, carry), given what each block has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in read_words(batch.column(1)):
                part, change = batch.slice(a, b - a), np.zeros(len(w.start) + 1, np.int64)
                items = [set(x or ()) for x in part.column("items").to_pylist()]
                for r, spans in enumerate(part.column("spans").to_pylist()):
                    for x in spans or ():
                        change[w.row_at[r] + x["start"]] += 1
                        change[w.row_at[r] + x["end"]] -= 1
                yield pa.RecordBatch.from_arrays([part.column(0), *summed(w, items, change), *(part.column(x) for x in carry)], [*NAMES, *carry])

    return docs.mapInArrow(released(run), typed(docs, carry))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted) and spans (runs of hit words) of each document, and its columns named in carry.

    docs: doc_id, text; benchmark: item_id, text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *(c for c in carry if c != "text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    blocks = -(-max(items.agg(F.sum(F.length("text"))).first()[0] or 0, 1) // block)

    def index_of(b: int) -> Index:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about `block` characters
        index = build(sorted((r.item_id, r.text) for r in rows), window)
        choose_prefixes(index, *(rarity(docs, index) if index.shingles else (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
        return index

    if blocks == 1:
        return probe(docs, index_of(0), carry)
    path = scratch(spark, "benchmark-hits")
    texts = docs.where("text is not null").select(F.md5("text").alias("digest"), "text")
    for b in range(blocks):
        hits(texts, index_of(b)).withColumn("block", F.lit(b)).write.mode("append").parquet(path)
    once = spark.read.schema(f"digest string, items array<string>, spans {SPANS}, block int").parquet(path)
    # copies of a text say the same, once for each block
    once = once.groupBy("digest", "block").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))
    of_text = once.groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    # null texts have no windows, and would all be one key
    out = docs.where("text is not null").withColumn("digest", F.md5("text")).join(of_text, "digest", "left")
    none = docs.where("text is null").select("*", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(SPANS).alias("spans"))
    return merged(out.select(*docs.columns, "items", "spans").unionByName(none), carry)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """Hit words make up a twentieth at least."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
