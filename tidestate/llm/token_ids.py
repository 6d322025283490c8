"""Token-id output: texts to ids with a public tokenizer, ids to range-coded files, and back.

Files are Parquet tables whose rows are segments; a segment's `code` holds, all little-endian,

    magic "TSR1", vocabulary u32, documents u32, blocks u32, bytes of the index u32, crc32 of the index u32,
    index: zlib of doc_ids i64[documents], known u8[documents] (0: the doc_id is null), lengths u32[documents],
    table: for each block ids u32, bytes u32, crc32 u32,
    the blocks' codes (see range_coder; each block is reset and checksummed on its own).

Segments are sorted by (part, seq), documents by doc_id over all of them. Spark commits the files, so that
a lost task is redone and no half-written file is read.

Defined results. A null text is empty; an empty text gives the end id alone. A null doc_id sorts first and stays
null. Repeated rows are written as often as they come. An empty table gives no segments and reads back
as no rows. Other columns are ignored. A damaged block or index raises ValueError.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import range_coder as R
from .common import pieces, released

HEAD = struct.Struct("<4s5I")
#: Ids that a segment holds before it is closed (its last document stays whole).
SEGMENT = R.BLOCK
#: Bytes of text tokenized at a time: a new piece is tokenized once for each.
CHUNK = 1 << 20
#: Distinct pieces of words whose ids a worker remembers, and places for them.
REMEMBERED = 1 << 18
#: Segments up to which their offsets are broadcast.
BROADCAST_SEGMENTS = 1_000_000
#: Bytes of input files for each partition.
PART_BYTES = 16 << 20
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
#: Fixed values of the tokenizer: its start token, and how the last token of a run of letters ends.
MARK = "<|startoftext|>"
END = "</w>"
SPLIT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: 1: ASCII letters, 2: digits, 3: other ASCII but white space, apostrophe and controls.
SMALL = K.lut(bytes(range(97, 123)))
KINDS = np.zeros(256, np.int8)
KINDS[33:127] = 3
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[48:58] = 2
KINDS[39] = 0


class WordIds:
    """Ids of pieces of words, each distinct piece tokenized once.

    The tokenizer lower-cases, drops white space, never joins what white space separates, and begins a new
    run where an ASCII letter, digit or other mark meets one of another of these classes, but for
    apostrophes; so a text's ids are its pieces' ids one after another. Texts with `<|` (which may begin
    a special token) are cut at white space only and keep their case.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        #: whether the tokenizer is of the kind described; others are given whole texts
        self.cuttable = SPLIT in json.dumps(spec["pre_tokenizer"]) and '"Lowercase"' in json.dumps(spec["normalizer"]) and spec["model"].get("end_of_word_suffix") == END
        # the same model for words of lower-case ASCII letters, which the normalizer and the pattern leave as they are
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})) if self.cuttable else None
        self.mark = self.tokenizer.token_to_id(MARK)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        # two-way table of remembered pieces
        self.key, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.remembered = np.zeros(0, np.int32), 0

    def encode(self, text: str, bare: bool = False) -> np.ndarray:
        return np.array((self.bare if bare else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces, one after another, and how many each has."""
        raw, at = K.gather(data, start, end, 10)
        words = raw.tobytes().decode().split("\n")[:-1]
        kind = np.where(K.per_row(~SMALL[raw], at) == 1, 0, 2)  # 0: ASCII letters alone, but for the gap
        kind[[i for i in np.flatnonzero(kind).tolist() if words[i].isalpha()]] = 1
        size, parts = np.zeros(len(words), np.int64), []
        for k in range(3):
            some = [words[i] for i in np.flatnonzero(kind == k).tolist()]
            ids = self.encode(" ".join(some), bare=k == 0) if k < 2 else np.zeros(0, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if k < 2 and len(last) == len(some):  # letters alone are one run, whose last token ends a word
                n = np.diff(last, prepend=-1)
            elif self.mark is not None and not any("<|" in w for w in some):
                ids = self.encode("".join(w + MARK for w in some))
                last = np.flatnonzero(ids == self.mark)
                ids, n = np.delete(ids, last), np.diff(last, prepend=-1) - 1
            else:
                each = [self.encode(w) for w in some]
                ids, n = np.concatenate([np.zeros(0, np.int32), *each]), [len(x) for x in each]
            size[kind == k] = n
            parts.append(ids)
        of = np.repeat(kind, size)
        ids = np.zeros(len(of), np.int32)
        for k, x in enumerate(parts):
            ids[of == k] = x
        return ids, size

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and start, end and first-of-row index (n + 1) of all pieces."""
        raw = data.tobytes()
        if b"<|" in raw:
            w = K.Words(data, offsets, K.NON_SPACE)
            return data, w.start, w.end, w.row_at
        w = K.Words(data, offsets, K.NON_SPACE, K.LOWER)
        kind = KINDS[w.data]
        cut = np.zeros(len(data) + 1, bool)
        # classes 1 to 3 may be cut from each other; 0 (white space, apostrophes, non-ASCII) from nothing
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] * kind[:-1] > 0)
        cut[offsets] = False
        inner = np.flatnonzero(cut)
        start, end = np.sort(np.concatenate([w.start, inner])), np.sort(np.concatenate([w.end, inner]))
        at = np.searchsorted(start, offsets)
        at[-1] = len(start)
        return w.data, start, end, at

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin (n + 1)."""
        if not self.cuttable:
            raw = data.tobytes()
            each = [x.ids for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        data, start, end, row_at = self.pieces(data, offsets)
        h = K.range_hash(data, start, end) | np.uint64(1)  # never 0, the mark of a free place
        i, j = (h >> np.uint64(64 - SLOT_BITS)).view(np.int64), ((h >> np.uint64(20)) & np.uint64(SLOTS - 1)).view(np.int64)
        slot = np.where(self.key.take(i) == h, i, j)
        new = np.flatnonzero(self.key.take(slot) != h)
        at, size, pool = self.at.take(slot), self.size.take(slot), self.pool
        if len(new):
            key, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            ids, n = self.fresh(data, start[first], end[first])
            to = (len(pool) + np.cumsum(n) - n).astype(np.int32)
            at[new], size[new] = to[which], n[which]
            pool = np.concatenate([pool, ids])
            if self.remembered < REMEMBERED:
                self.pool = pool
                i, j = i[first], j[first]
                free = np.where(self.key[i] == 0, i, j)
                ok = self.key[free] == 0
                spot, one = np.unique(free[ok], return_index=True)
                self.key[spot], self.at[spot], self.size[spot] = key[ok][one], to[ok][one], n[ok][one]
                self.remembered += len(spot)
        where = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=where[1:])
        out = pool.take(np.repeat(at - where[:-1], size) + np.arange(where[-1]))
        return out, where[row_at]


WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's WordIds of a tokenizer file; kept from task to task."""
    if path not in WORD_IDS:
        WORD_IDS.clear()
        WORD_IDS[path] = WordIds(path)
    return WORD_IDS[path]


def pack(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    """A segment's bytes. ids: of all its documents; sizes: of each."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + sizes.astype("<u4").tobytes(), 1)
    blocks = [ids[a : a + R.BLOCK] for a in range(0, len(ids), R.BLOCK)]
    codes = [R.encode(b, vocabulary) for b in blocks]
    table = np.array([[len(b), len(c), zlib.crc32(c)] for b, c in zip(blocks, codes, strict=True)], "<u4").tobytes()
    return HEAD.pack(b"TSR1", vocabulary, len(doc_ids), len(blocks), len(index), zlib.crc32(index)) + index + table + b"".join(codes)


def unpack(code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, known, ids and sizes of a segment."""
    magic, vocabulary, docs, n, size, crc = HEAD.unpack_from(code)
    index = code[HEAD.size : HEAD.size + size]
    if magic != b"TSR1" or zlib.crc32(index) != crc:
        raise ValueError("damaged segment index")
    raw = zlib.decompress(index)
    doc_ids, known, sizes = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs), np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
    at = HEAD.size + size
    table = np.frombuffer(code, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
    at += 12 * n
    blocks = []
    for count, k, crc in table.tolist():
        block = code[at : at + k]
        at += k
        if zlib.crc32(block) != crc:
            raise ValueError("damaged block")
        blocks.append(R.decode(block, count, vocabulary).astype(np.uint32))
    return doc_ids, known, np.concatenate(blocks), sizes


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Tokenizes docs (doc_id, text), appends end_id to each document, and writes segments in ascending doc_id order to path."""
    n = partitions or pieces(docs, PART_BYTES, docs.sparkSession.sparkContext.defaultParallelism)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        words = word_ids(tokenizer)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            ids, size = np.concatenate(held), np.concatenate(sizes)
            code = pack(names, ids, size, max(words.vocabulary, end_id + 1))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([code], pa.binary())], ["part", "seq", "n_ids", "code"])
            seq += 1
            for x in (names, held, sizes):
                x.clear()
            return row

        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets, CHUNK):
                ids, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names += batch.column(0).slice(a, b - a).to_pylist()
                held.append(np.insert(ids, at[1:], end_id))
                sizes.append(np.diff(at) + 1)
                if sum(map(len, held)) >= SEGMENT - (SEGMENT >> 3):
                    yield close()
        if names:
            yield close()

    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(released(run), "part int, seq int, n_ids long, code binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document in path."""
    segments = spark.read.schema("part int, seq int, n_ids long, code binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, known, ids, sizes = unpack(batch.column(2)[i].as_py())
                raw = ids.astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                step = max(1, int(len(sizes) * (4 << 20) // max(raw.nbytes, 1)))
                for a in range(0, len(sizes), step):
                    b = min(a + step, len(sizes))
                    body = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((4 * (at[a : b + 1] - at[a])).astype(np.int64)), pa.py_buffer(raw[at[a] : at[b]])]).cast(pa.binary())
                    cols = [pa.array(np.full(b - a, batch.column(j)[i].as_py(), np.int32)) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(doc_ids[a:b], mask=known[a:b] == 0), pa.array(at[a:b]), pa.array(sizes[a:b]), body], ["part", "seq", "doc_id", "inside", "n_tokens", "ids"])

    docs = segments.select("part", "seq", "code").mapInArrow(released(run), "part int, seq int, doc_id long, inside long, n_tokens long, ids binary")
    # ids before each part (a row a part), and before each segment of it
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    before = segments.select("part", "seq", inside.alias("before_segment")).join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("before_segment")).alias("before"))
    # three numbers a segment of millions of ids; beyond the bound they are joined by a shuffle
    if segments.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS:
        before = F.broadcast(before)
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")
