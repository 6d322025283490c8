import random
import re

import pytest

from tidestate.llm import near_dedup as N
from tidestate.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is not None and i == find(i)) for i, s in sets), key=str)


def run(df, k):
    return sorted((tuple(r) for r in N.near_duplicates(df, k).collect()), key=str)


def test_edge_cases(edge, texts):
    assert run(edge, 4) == brute(texts, 4)


def test_empty(empty):
    assert run(empty, 4) == []


@pytest.mark.parametrize("block", [2000, 7])
def test_families_and_chains(spark, monkeypatch, block):
    """Near copies of copies: chains whose ends are unlike, families that overlap, dealt out in small blocks too."""
    monkeypatch.setattr(N, "BLOCK", block)
    r, pairs = random.Random(5), []
    for _ in range(4):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([20, 60, 150]))]
        for _c in range(25):
            if r.random() < 0.5:
                base = list(base)
                base[r.randrange(len(base))] = f"v{r.randrange(10_000)}"
            pairs.append((len(pairs) * 7 % 1009, " ".join(base)))
    assert run(spark.createDataFrame(pairs, "doc_id long, text string"), 4) == brute(pairs, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys((100, 101, 103), 100)}


def test_words_that_polynomials_take_for_one(spark):
    from tests.llm.test_counting import thue_morse

    x, y = thue_morse(11)
    pairs = [(1, f"{x} p q r"), (2, f"{y} p q r"), (3, f"{x} p q r"), (4, " ".join([*x[:64]])), (5, " ".join([*y[:64]])), (6, x), (7, y)]
    assert run(spark.createDataFrame(pairs, "doc_id long, text string"), 4) == brute(pairs, 4)


def test_components_write_no_more_than_they_need(spark, monkeypatch):
    """Stars and empty tables are written once: rounds and the plans of them fill the driver."""
    from tidestate.llm import components as C

    names, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, what: names.append(what) or stored(df, what))
    stars = [(i, 10 * (i // 10)) for i in range(40)]
    assert dict(map(tuple, C.components(spark.createDataFrame(stars, "u long, v long")).collect())) == dict(stars)
    assert C.components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert len(names) == 2


def test_stages_of_a_run(spark, sf):
    """Every stage and scan costs the driver memory: a run took 164 when star-shaped links went through rounds and tasks were dealt out twice."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextStageId()
    assert N.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), 5).collect()
    assert scheduler.nextStageId() - before < 150
