import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidestate.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, k=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - k + 1):
                g = tuple(w[j : j + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in S.substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_edge_cases(edge, texts):
    assert run(edge) == brute(texts)


def test_spans_and_texts(spark):
    a = " ".join(f"a{i}" for i in range(30))
    b = "x y " + " ".join(f"a{i}" for i in range(5, 25)) + " z"
    got = {r.doc_id: r for r in S.substring_dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert got[1].spans == [] and got[1].kept == a
    assert [tuple(s) for s in got[2].spans] == [(2, 22)] and got[2].kept == "x y z"


def test_same_id_other_text(spark):
    a = " ".join(f"a{i}" for i in range(30))
    pairs = [(1, a), (2, a), (2, "u v " + a), (2, " ".join(f"b{i}" for i in range(40)))]
    assert run(spark.createDataFrame(pairs, "doc_id long, text string")) == brute(pairs)


def test_empty(empty):
    assert run(empty) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c".split()), max_size=60), min_size=1, max_size=12))
def test_few_words_repeat_much(spark, docs):
    pairs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert run(spark.createDataFrame(pairs, "doc_id long, text string")) == brute(pairs)


def test_words_that_polynomials_take_for_one(spark):
    from tests.llm.test_counting import thue_morse

    x, y = thue_morse(11)
    q = " ".join(f"q{i}" for i in range(15))
    a, b = (" ".join(z[:1024]) for z in (x, y))
    pairs = [(1, f"{x} {q}"), (2, f"{y} {q}"), (3, f"u {x} {q}"), (4, a), (5, b), (6, f"{x} " * 13), (7, f"{y} " * 13)]
    assert run(spark.createDataFrame(pairs, "doc_id long, text string")) == brute(pairs)


def block_of(*texts):
    import numpy as np

    raw = [t.encode() + b" " for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])


def test_factors_of_a_text():
    """Greedy factors with their sources: each as long as its source agrees, the next begun by the first straddling window that is known."""
    import numpy as np

    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(30)]
    text = ["x", *a[5:25], *b[3:20], "y", *a[30:40], *b[10:20]]
    body, length = block_of(" ".join(a), " ".join(b), " ".join(text))
    seg, s, j, n, at = S.factors(body, length, np.array([1, 2, 9]))
    assert [(g, x - at[2], y, k) for g, x, y, k in zip(seg, s, j, n, strict=True)] == [(2, 1, 5, 20), (2, 21, 40 + 3, 17)]
    # a source that straddles: what a window across two factors' ends repeats is found as well
    body, length = block_of(" ".join(a[:20]), " ".join([*a[10:20], *b[:10]]), " ".join([*a[:20], *b[:10]]))
    seg, s, j, n, at = S.factors(body, length, np.array([1, 2, 9]))
    assert [(x - at[2], y, k) for x, y, k in zip(s, j, n, strict=True)] == [(0, 0, 20), (10, 20, 20)]
    # sources of larger doc_ids are none
    assert not len(S.factors(*block_of(" ".join(a), " ".join(a)), np.array([5, 5]))[0])


def test_colliding_hashes_are_noticed(monkeypatch):
    import numpy as np

    from tidestate.llm import kernels as K

    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    true = K.window_hash
    monkeypatch.setattr(K, "window_hash", lambda h, k: true(h, k) * np.uint64(0))
    seg, s, j, n, at = S.factors(*block_of(a, b, b), np.array([1, 2, 3]))
    assert [tuple(map(int, r)) for r in zip(seg, s, j, n, strict=True)] == [(2, 40, 20, 20)]


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "SAMPLED", 1)
    line = " ".join(f"l{i}" for i in range(16))
    pairs = [(i, f"{' '.join(f'd{i}x{j}' for j in range(20))} {line} {' '.join(f'e{i % 7}x{j}' for j in range(20))}") for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert len(S.hot_anchors(df, 13, 4))
    assert run(df) == brute(pairs)


def test_small_batches(spark, edge, texts, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 300)
    assert run(edge.repartition(5)) == brute(texts)


def test_white_space_between_words_does_not_matter(spark, monkeypatch):
    import numpy as np

    a, b = "\n".join(f"a{i}" for i in range(20)), " \t ".join(f"a{i}" for i in range(20))
    monkeypatch.setattr(np, "unique", None)  # the block needn't be parsed anew
    assert len(S.factors(*block_of(a, b), np.array([1, 2]))[0]) == 1
