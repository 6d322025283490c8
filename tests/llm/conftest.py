import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, kept string, tag string, ids string"
PROSE = "the river ran past the old mill and every stone in it was known to the miller who counted them twice a year before the snow came down from the hills and hid the road"


def rows(*pairs):
    """Documents with extra columns of clashing names."""
    return [(i, t, l, s, None, "x", "y", "z", "u", "v") for i, t, l, s in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, ties."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    return spark.createDataFrame(
        rows(
            (1, PROSE, "en", "a"),
            (2, None, "en", "a"),
            (3, "", None, "b"),
            (4, "   \n\t ", "fr", None),
            (5, PROSE, "en", None),
            (5, PROSE, "en", None),
            (None, PROSE, None, None),
            (6, "one two", "de", "c"),
            (7, "été 12 !!! 中文 \U0001f600", "fr", "b"),
            (8, long_text, "en", "a"),
            (9, PROSE.upper(), "en", "a"),
            (10, "123 456 --- 789", "en", "c"),
            (11, PROSE + " and more words of another kind that nobody else here has ever written down", "en", "c"),
        ),
        SCHEMA,
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def texts(edge):
    return [(r.doc_id, r.text) for r in edge.collect()]
