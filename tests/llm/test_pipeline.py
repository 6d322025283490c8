"""Each stage of the pipeline on what its predecessor kept, against plain Python."""




import pytest

import corpus_pipeline as C
from tests.llm.test_counting import base, check_mix, decon
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_token_ids import brute as tokens


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, at = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, out[-1], sf).write.parquet(str(at / str(k)))
        out.append(spark.read.parquet(str(at / str(k))))
    return [[r.asDict() for r in df.collect()] for df in out]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES][0] == "quality rules" and len(C.STAGES) == 5
    for rows in stages[1:5]:
        assert list(rows[0]) == C.COLUMNS
    whole = {r["doc_id"]: r for r in stages[0]}
    assert all(r == whole[r["doc_id"]] for rows in stages[1:5] for r in rows)


def test_rules_keep_clean_documents(stages, spark, sf):
    kept = {r["doc_id"] for r in stages[1]}
    clean = {i for i, t in pairs(stages[0]) if (b := base(t))[0] >= 20 and 100 * b[4] <= 30 * b[0]}
    assert kept <= clean
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} & clean
    assert len(good & kept) >= 0.97 * len(good)


def test_near_keeps_one_of_each_group(stages):
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(i for i, _, _, k in near(pairs(stages[1]), 5) if k)


def test_benchmark_documents_go(stages, spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(i for i, *_, bad in decon(pairs(stages[2]), items) if not bad)


def test_mix_takes_effect(stages):
    from collections import Counter

    copies = Counter(r["doc_id"] for r in stages[4])

    class Row:
        def __init__(self, r, sizes, want):
            self.source, self.copies = r["source"], copies[r["doc_id"]]
            self.size = len((r["text"] or "").split())
            self.source_size, self.target = sizes[self.source], want[self.source]

    from tests.llm.test_counting import water_level

    sizes = Counter()
    for r in stages[3]:
        sizes[r["source"]] += len((r["text"] or "").split())
    want = water_level(sizes)
    _, taken = check_mix([Row(r, sizes, want) for r in stages[3]], [(r["source"], r["text"]) for r in stages[3]])
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.1, abs=60)


def test_tokens_of_every_copy(stages):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages[5])
    assert got == sorted((s, i, n, c) for i, s, n, c in tokens(pairs(stages[4])))


def test_run_gives_the_last_stage(spark, sf, stages):
    got = sorted(tuple(r) for r in C.run(spark, sf).collect())
    assert got == sorted(tuple(r.values()) for r in stages[5])


def test_empty_documents(spark, sf, empty):
    docs = empty.select(C.COLUMNS)
    for _, f in C.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0
        docs = empty.select(C.COLUMNS)


def test_edge_rows_pass_through(spark, sf, edge):
    docs = edge.select(C.COLUMNS)
    for _, f in C.STAGES[1:]:
        assert f(spark, docs, sf).count() > 0


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def ids(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def good(stages):
    """Texts that the rules, near-dedup and decontamination kept."""
    return [r["text"] for r in stages[3][:6]]


def test_rules_judge_rows(spark, sf, good):
    bad = "one two"
    whole = spark.read.parquet(f"{sf}/documents.parquet").select(C.COLUMNS)
    more = rows_of(spark, (None, good[0], "m"), (None, bad, "m"), (-7, good[1], "m"), (-7, bad, "m"))
    got = C.rules(spark, whole.unionByName(more), sf).where("source = 'm'")
    assert ids(got) == sorted([(None, good[0]), (-7, good[1])], key=str)


def test_near_keeps_one_row_of_each_group(spark, sf, good):
    a, b, c, d = good[:4]
    got = C.near(spark, rows_of(spark, (None, a, "m"), (None, a, "m"), (None, b, "m"), (1, b, "m"), (2, c, "m"), (2, c, "m"), (3, c, "m"), (3, d, "m")), sf)
    assert ids(got) == sorted([(None, a), (1, b), (2, c), (3, d)], key=str)


def test_benchmark_judges_rows(spark, sf, good):
    leak = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    got = C.benchmark(spark, rows_of(spark, (None, good[0], "m"), (None, leak, "m"), (4, good[1], "m"), (4, leak, "m")), sf)
    assert ids(got) == sorted([(None, good[0]), (4, good[1])], key=str)


def test_mix_takes_rows_by_themselves(spark, sf):
    # weights 1 and 2, 40 and 20 words: a is taken for 20 of its 40 words, b twice
    a = [" ".join(f"a{i}{j}" for j in range(10)) for i in range(4)]
    b = [" ".join(f"b{i}{j}" for j in range(10)) for i in range(2)]
    got = C.mix(spark, rows_of(spark, *((1, t, "a") for t in a), *((None, t, "b") for t in b)), sf).collect()
    assert sorted(r.text for r in got if r.source == "b") == sorted(b * 2)
    assert len({r.text for r in got if r.source == "a"}) == len([r for r in got if r.source == "a"]) == 2
