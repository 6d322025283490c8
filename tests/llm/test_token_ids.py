import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestate.llm import kernels as K
from tidestate.llm import range_coder, token_ids
from tidestate.llm.common import scratch, tokenizer_path

PATH = tokenizer_path()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 49407), min_size=1, max_size=400), st.integers(1, 7))
def test_coder_round_trip(ids, least):
    x = np.array(ids)
    was, range_coder.LEAST_STEPS = range_coder.LEAST_STEPS, least
    try:
        assert (range_coder.decode(range_coder.encode(x, 49408), len(x), 49408) == x).all()
    finally:
        range_coder.LEAST_STEPS = was


@pytest.mark.parametrize("vocabulary", [2, 300, 70_000, 1 << 20])
def test_coder_vocabularies_and_repeats(vocabulary):
    rng = np.random.default_rng(vocabulary)
    x = np.concatenate([rng.integers(0, vocabulary, 5000), np.zeros(3000, int), np.tile(rng.integers(0, vocabulary, 50), 60)])
    assert (range_coder.decode(range_coder.encode(x, vocabulary), len(x), vocabulary) == x).all()


def test_orders_pay():
    """Below the entropy of single ids where contexts tell more; near it where they tell nothing."""
    rng = np.random.default_rng(3)
    p = 1 / np.arange(1, 3001)
    alone = rng.choice(3000, 200_000, p=p / p.sum())
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum()
    assert 8 * len(range_coder.encode(alone, 49408)) / len(alone) < 1.1 * entropy
    follow = rng.integers(0, 3000, (3000, 2))
    chain = np.zeros(200_000, np.int64)
    for i, which in enumerate(rng.integers(0, 2, len(chain) - 1)):
        chain[i + 1] = follow[chain[i], which]
    counts = np.bincount(chain)
    q = counts[counts > 0] / len(chain)
    assert 8 * len(range_coder.encode(chain, 49408)) / len(chain) < 0.4 * -(q * np.log2(q)).sum()


def test_entropy_of_documents():
    """On real ids the mixture is below order 0."""
    import pyarrow.parquet as pq

    words = token_ids.word_ids(PATH)
    data, offsets = K.buffers(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"])
    ids, _ = words(data, offsets)
    n = np.bincount(ids)
    q = n[n > 0] / len(ids)
    assert 8 * len(range_coder.encode(ids, 49408)) / len(ids) < -(q * np.log2(q)).sum()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tabcXYZ019'.,-!<|>=é̸́  中"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_tokenizers_ids(texts):
    words = token_ids.word_ids(PATH)
    data, offsets = K.buffers(pa.array(texts, pa.string()))
    ids, at = words(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b <|STARTOFTEXT|>", "it's we'll DON'T x,'s 's", "a≠b ≮ 1⃣", "İstanbul ΣΣ", "don’t 12ab34"])
def test_awkward_texts(text):
    words = token_ids.WordIds(PATH)
    data, offsets = K.buffers(pa.array([text, "plain words"], pa.string()))
    ids, at = words(data, offsets)
    assert ids[: at[1]].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def brute(texts):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, x in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_id(spark, edge, texts):
    from pyspark.sql import functions as F

    path = scratch(spark, "t")
    token_ids.write(edge, path, PATH, partitions=3)
    got = token_ids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(texts)


def test_damage_is_noticed(spark, edge):
    path = scratch(spark, "t")
    token_ids.write(edge, path, PATH, partitions=1)
    code = bytearray(spark.read.parquet(path).first().code)
    code[-3] ^= 1
    with pytest.raises(ValueError, match="damaged block"):
        token_ids.unpack(bytes(code))


def test_empty_table(spark, empty):
    path = scratch(spark, "t")
    token_ids.write(empty, path, PATH)
    assert token_ids.read(spark, path).count() == 0


def test_words_that_polynomials_take_for_one(spark):
    from pyspark.sql import functions as F

    from tests.llm.test_counting import thue_morse

    pairs = list(enumerate(thue_morse(11)))
    path = scratch(spark, "t")
    token_ids.write(spark.createDataFrame(pairs, "doc_id long, text string"), path, PATH, partitions=1)
    got = token_ids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(pairs)
