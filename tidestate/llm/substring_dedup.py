"""Substring dedup by relative Lempel-Ziv parsing.

Texts are words `[^\\x20\\x09-\\x0D]+`. Every window of WINDOW words has an anchor, the run of ANCHOR of its words of
least hash, and a document is cut into segments, the runs of windows of one anchor (neighbours
overlap by WINDOW - 1 words). All segments of an anchor meet in one reference block, so that each document is parsed against the blocks
that can hold its windows, and against no other.

A block's segments, in order of the least doc_id that has them, are its reference, and its windows are the index. Each segment is
parsed greedily against what comes before it of smaller doc_ids: where a window is in the index, a factor begins, whose source is the
window's earliest place in the reference, and it goes on word by word for as long as its source agrees. What lies inside a factor is not
looked at again; windows that straddle its end are looked up one after another, and the first that is found begins the next factor. Factors are
WINDOW words or longer and are the duplicate spans. A factor's words are compared with its source's byte by byte; should two unlike windows
share a hash, the block is parsed anew with exact numbers of words and windows.

Work is combined before it is shuffled: of the segments of a batch of documents that are alike, only those of the least doc_id go to the
block, as compressed text; the others are duplicates already, a factor as long as the segment each. An anchor that a large
share of all documents has (HOT) is found by counting a sample of the documents; its windows are dealt out one by one, by their own
hash. The sample decides where windows meet and nothing else: results are the same for any.

Defined results. A null text has no words; texts of fewer than WINDOW words lose nothing. Rows of equal doc_id
don't count as smaller, so repeated rows stay alike. A row of null doc_id is kept whole and
takes from no other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import give_back, pieces, released

WINDOW = 13
ANCHOR = 4
#: Bytes of input files for each reference block, and of segments that a worker gathers before it passes them on.
BLOCK_BYTES = 3 << 20
BATCH_BYTES = 14 << 20
#: Segments from which an anchor's windows are dealt out one by one; more if more than a millionth of all segments, so that
#: there are never more than a million such anchors. One in SAMPLED documents is counted.
HOT, SAMPLED, MOST_HOT = 20_000, 16, 1_000_000
OTHER = np.uint64(0x5851F42D4C957F2D)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of neighbouring values begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def segments(w: K.Words, window: int, anchor: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, end word, key (what its windows are dealt by) and two content hashes of each segment of w's rows."""
    h, starts = w.hashes(), K.window_starts(w.row_at, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, *[none.view(np.uint64)] * 3
    key = sliding_min(K.window_hash(h, anchor), window - anchor + 1)[starts]
    whole = K.window_hash(h, window)[starts]
    if len(hot):
        key = np.where(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key, whole, key)
    first = runs(key, starts - np.arange(len(starts)))
    last = np.append(first[1:], len(starts)) - 1
    place = np.arange(len(starts)) - np.repeat(first, last - first + 1)
    x = K.join(whole, place.astype(np.uint64))
    return starts[first], starts[last] + window, key[first], np.add.reduceat(x, first), np.add.reduceat(K.mix(x ^ OTHER), first)


def hot_anchors(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """The anchors of HOT segments or more, estimated from one in SAMPLED of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for a, b in K.chunks(offsets):
                w = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.NON_SPACE)
                key, n = np.unique(segments(w, window, anchor, np.zeros(0, np.uint64))[2], return_counts=True)
                often = n > 1
                cols = [pa.array([*key[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), int(n.sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "n"])

    sample = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)).select("text")
    n = F.sum("n").alias("n")
    rows = sample.mapInArrow(released(count), "anchor long, n long").groupBy("anchor").agg(n).where(f"anchor is null or n >= {max(HOT // SAMPLED, 1)}")
    total = rows.where("anchor is null").agg(n).first()["n"] or 0
    got = rows.where("anchor is not null").where(F.col("n") > total // MOST_HOT).select("anchor").collect()  # MOST_HOT rows at most
    return np.unique(np.array([r["anchor"] for r in got], np.int64).view(np.uint64))


def spans_of(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """doc_id, tag and spans (little-endian i32 pairs): overlapping word ranges of one document made one."""
    order = np.lexsort((end, begin, tag, doc))
    d, t, b, e = doc[order], tag[order], begin[order], end[order]
    own = runs(d, t)
    # the ends so far within a document: ranges of one text begin and end in the same order
    new = np.ones(len(d), bool)
    new[1:] = b[1:] > e[:-1]
    new[own] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1
    ranges = np.stack([b[at], e[last] if len(at) else e[:0]], 1).astype("<i4")
    place = np.append(np.searchsorted(at, own), len(at)).astype(np.int32)
    body = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(8 * place), pa.py_buffer(np.ascontiguousarray(ranges))])
    return pa.Table.from_arrays([pa.array(d[own]), pa.array(t[own]), body], ["doc_id", "tag", "spans"])


def coded(doc: np.ndarray, tag: np.ndarray, *columns: np.ndarray) -> bytes:
    """Places as bytes: doc_ids and tags as differences."""
    parts = [np.diff(x, prepend=0).astype("<i8").tobytes() for x in (doc, tag)] + [x.astype("<i4").tobytes() for x in columns]
    return zlib.compress(len(doc).to_bytes(8, "little") + b"".join(parts), 4)


def decoded(code: bytes, columns: int) -> list[np.ndarray]:
    p = zlib.decompress(code)
    m = int.from_bytes(p[:8], "little")
    out = [np.cumsum(np.frombuffer(p, "<i8", m, 8 + 8 * m * i)) for i in range(2)]
    return out + [np.frombuffer(p, "<i4", m, 8 + 16 * m + 4 * m * i).astype(np.int64) for i in range(columns)]


def cut(docs: DataFrame, blocks: int, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """block, texts, places: the segments of docs (doc_id, tag, text), by reference block. Rows of negative block hold spans that are known already."""
    cast = docs.sparkSession.sparkContext.broadcast(hot)  # MOST_HOT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = pa.Codec("zstd", 1)
        held: list[tuple[np.ndarray, ...]] = []
        size, closed, part = 0, 0, TaskContext.get().partitionId()

        def row(block: int, texts: bytes, places: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (texts, places))], ["block", "texts", "places"])

        def close() -> Iterator[pa.RecordBatch]:
            """Everything held, one row a block: lengths and bytes of distinct segments; segment, doc_id, tag and first word of each place."""
            text = np.concatenate([x[0] for x in held])
            length, block, content, other, doc, tag, first, words = (np.concatenate([x[i] for x in held]) for i in range(1, 9))
            held.clear()
            begin = np.cumsum(length) - length
            order = np.lexsort((doc, other, content))
            one = runs(content[order], other[order])
            group = np.zeros(len(order), np.int64)
            group[one] = 1
            least = doc[order[one]][np.cumsum(group) - 1]
            later = order[doc[order] > least]
            if len(later):
                known = spans_of(doc[later], tag[later], first[later], first[later] + words[later])
                ranges = np.frombuffer(K.buffers(known["spans"])[0].tobytes(), "<i4").reshape(-1, 2)
                n = np.diff(K.buffers(known["spans"])[1]) // 8
                yield row(-1 - (part << 24) - closed, b"", coded(*(np.repeat(known[c].to_numpy(), n) for c in ("doc_id", "tag")), ranges[:, 0], ranges[:, 1]))
            group = (np.cumsum(group) - 1)[doc[order] == least]
            order = order[doc[order] == least]  # sorted by segment
            # by block, then by the segment's first place in the batch
            lead = order[runs(group)]
            place = np.lexsort((order, lead[group], block[order]))
            order, group = order[place], group[place]
            at = runs(block[order])
            for a, b in zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True):
                o, new = order[a:b], runs(group[a:b])
                which = np.zeros(b - a, np.int64)
                which[new[1:]] = 1
                r = o[new]
                to = np.cumsum(length[r])
                body = text[np.repeat(begin[r] - (to - length[r]), length[r]) + np.arange(to[-1])]
                raw = np.array([len(r), len(body)], "<i8").tobytes() + length[r].astype("<i4").tobytes() + body.tobytes()
                yield row(int(block[o[0]]), np.array([len(raw)], "<i8").tobytes() + codec.compress(raw, asbytes=True), coded(doc[o], tag[o], first[o], which))

        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in K.chunks(offsets):
                w = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.NON_SPACE)
                first, end, key, content, other = segments(w, window, anchor, cast.value)
                if not len(first):
                    continue
                of = np.searchsorted(w.row_at, first, "right") - 1
                text, at = K.gather(w.data, w.start[first], w.end[end - 1], 32)
                held.append((text, np.diff(at), (K.mix(key) % np.uint64(blocks)).astype(np.int64), content, other, doc[a:b][of], tag[a:b][of], first - w.row_at[of], end - first))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield from close()
                    size, closed = 0, closed + 1
        if held:
            yield from close()

    return docs.mapInArrow(released(run), "block long, texts binary, places binary")


def extend(h: np.ndarray, s: np.ndarray, j: np.ndarray, have: int, room: np.ndarray) -> np.ndarray:
    """How many of h agree from s and from j on, of at most room; have of them are known to."""
    out = np.full(len(s), have, np.int64)
    live, step = np.flatnonzero(out < room), 8
    while len(live):
        at = out[live][:, None] + np.arange(step)
        same = at < room[live][:, None]
        same &= h.take(np.minimum(s[live][:, None] + at, len(h) - 1)) == h.take(np.minimum(j[live][:, None] + at, len(h) - 1))
        n = np.where(same.all(1), step, same.argmin(1))
        out[live] += n
        live, step = live[n == step], min(2 * step, 1024)
    return out


def parse(h: np.ndarray, key: np.ndarray, count: np.ndarray, earliest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy factors of all segments: segment, first word, first word of the source (both counted through the block) and length.

    h: of each word; key: of each window; count: words of each segment; earliest: the least doc_id of each.
    """
    word_at = np.concatenate([[0], np.cumsum(count)])
    window_at = np.concatenate([[0], np.cumsum(count - window + 1)])  # a segment has a window at least
    of = np.repeat(np.arange(len(count)), count - window + 1)
    start = np.arange(window_at[-1]) + (word_at[:-1] - window_at[:-1])[of]
    doc = earliest[of]
    order = np.lexsort((doc, key))
    one = runs(key[order])
    source = np.empty(len(order), np.int64)
    source[order] = np.repeat(order[one], np.diff(np.append(one, len(order))))
    found = np.flatnonzero(doc[source] < doc)
    at, end, out = window_at[:-1], window_at[1:], []
    while len(at):  # the next factor of every segment that has one
        i = np.searchsorted(found, at)
        ok = i < len(found)
        w = found[np.minimum(i, len(found) - 1)] if len(found) else at
        ok &= w < end
        w, end = w[ok], end[ok]
        s, j = start[w], start[source[w]]
        n = extend(h, s, j, window, np.minimum(word_at[of[w] + 1] - s, word_at[of[source[w]] + 1] - j))
        out.append((of[w], s, j, n))
        at = w + n - window + 1  # the first window that is not inside the factor
    seg, s, j, n = (np.concatenate([x[k] for x in out]) for k in range(4)) if out else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((s, seg))
    return seg[order], s[order], j[order], n[order]


def factors(body: np.ndarray, length: np.ndarray, earliest: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """parse of a block's segments, given as words each followed by a space (body; length: bytes of each segment); and where each segment's words begin."""
    off = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    words = [K.Words(body[off[a] : off[b]], off[a : b + 1] - off[a], K.NON_SPACE) for a, b in K.chunks(off)]
    base = [off[a] for a, _ in K.chunks(off)]
    h, count = np.concatenate([w.hashes() for w in words]), np.concatenate([w.count for w in words])
    start, end = (np.concatenate([x + b for x, b in zip(y, base, strict=True)]) for y in ([w.start for w in words], [w.end for w in words]))
    word_at = np.concatenate([[0], np.cumsum(count)])
    starts = K.window_starts(word_at, window)
    seg, s, j, n = parse(h, K.window_hash(h, window)[starts], count, earliest, window)
    same = np.ones(len(s), bool)
    for a in range(0, len(s), 1 << 13):  # word by word and byte by byte: white space between words may differ
        f = np.repeat(np.arange(a, min(a + (1 << 13), len(s))), n[a : a + (1 << 13)])
        inside = np.arange(len(f)) - np.repeat(np.cumsum(n[a : a + (1 << 13)]) - n[a : a + (1 << 13)], n[a : a + (1 << 13)])
        x, y = s[f] + inside, j[f] + inside
        alike = end[x] - start[x] == end[y] - start[y]
        same[f[~alike]] = False
        f, x, y = f[alike], x[alike], y[alike]
        own, at = K.gather(body, start[x], end[x], 32)
        same[f[K.per_row(own != K.gather(body, start[y], end[y], 32)[0], at) > 0]] = False
    if not same.all():
        raw, number = body.tobytes(), {}
        exact = np.array([number.setdefault(raw[x:y], len(number)) for x, y in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
        key = np.unique(exact[starts[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
        seg, s, j, n = parse(exact, key, count, earliest, window)
    return seg, s, j, n, word_at


def factored(window: int) -> object:
    """A function of a reference block's rows that gives, for each document, the spans of words to be removed."""

    def run(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() < 0:
            doc, tag, begin, end = (np.concatenate(x) for x in zip(*(decoded(p.as_py(), 2) for p in table["places"]), strict=True))
            return spans_of(doc, tag, begin, end)
        codec = pa.Codec("zstd", 1)
        bodies, lengths, places, n_segments = [], [], [], 0
        for texts, p in zip(table["texts"], table["places"], strict=True):
            t = texts.as_py()
            raw = codec.decompress(t[8:], int.from_bytes(t[:8], "little"), asbytes=True)
            n, size = np.frombuffer(raw, "<i8", 2).tolist()
            lengths.append(np.frombuffer(raw, "<i4", n, 16))
            bodies.append(np.frombuffer(raw, np.uint8, size, 16 + 4 * n))
            doc, tag, first, which = decoded(p.as_py(), 2)
            places.append((doc, tag, first, np.cumsum(which) + n_segments))
            n_segments += n
        doc, tag, first, seg = (np.concatenate(x) for x in zip(*places, strict=True))
        # all places of a segment that reach the block are of one doc_id, the batch's least
        earliest = np.empty(n_segments, np.int64)
        earliest[seg] = doc
        g, s, _, n, word_at = factors(np.concatenate(bodies), np.concatenate(lengths), earliest, window)
        # the factors of every place's segment
        a, b = np.searchsorted(g, seg), np.searchsorted(g, seg, "right")
        of = np.repeat(np.arange(len(seg)), b - a)
        f = np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        begin = first[of] + s[f] - word_at[seg[of]]
        out = spans_of(doc[of], tag[of], begin, begin + n[f])
        give_back(collect=False)
        return out

    return run


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text: the tag tells apart texts that share a doc_id, and is 0 where no doc_id comes twice."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    twice = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("tag"), "text")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Of docs (doc_id, tag, text), none of null doc_id: doc_id, tag, spans: pieces of each document's duplicate word ranges (little-endian i32 pairs; start, end), a row for each block and document."""
    blocks = pieces(docs, BLOCK_BYTES, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    segments_ = cut(docs, blocks, window, anchor, hot_anchors(docs, window, anchor))
    return segments_.groupBy("block").applyInArrow(factored(window), "doc_id long, tag long, spans binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by a space), kept_sha256 and spans (removed word ranges) of each document (doc_id, text)."""
    docs = tagged(docs)
    known = docs.where("doc_id is not null")
    found = duplicate_spans(known, window, anchor).groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans"))
    # spans are the small side and unique by key: no sort of the texts
    both = known.join(found.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    # rows of null doc_id stay out of the join, where they all would be one key
    both = both.unionByName(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                w = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.NON_SPACE)
                change = np.zeros(len(w.start) + 1, np.int64)
                for r, spans in enumerate(batch.column(2).slice(a, b - a)):
                    if spans.is_valid:
                        s = np.frombuffer(K.buffers(spans.values)[0].tobytes(), "<i4").reshape(-1, 2) + w.row_at[r]
                        np.add.at(change, s[:, 0], 1)
                        np.add.at(change, s[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.flatnonzero(~gone)
                text, at = K.gather(w.data, w.start[kept], w.end[kept], 32)
                row = at[np.searchsorted(kept, w.row_at)]
                raw = text.tobytes()
                kept_texts = [raw[i : max(i, j - 1)] for i, j in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)]
                edge = np.zeros(len(gone) + 1, bool)
                edge[w.row_at] = True
                begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
                end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                of = np.searchsorted(w.row_at, begin, "right") - 1
                ranges = pa.StructArray.from_arrays([pa.array((x - w.row_at[of]).astype(np.int32)) for x in (begin, end)], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)), ranges)
                cols = [batch.column(0).slice(a, b - a), pa.array(w.count), pa.array(K.per_row(gone, w.row_at)), pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts], pa.string()), spans]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"])

    return both.mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<start: int, end: int>>")
