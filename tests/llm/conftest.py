import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, _w string, key bigint, start int, line string, score double"


def awkward_rows():
    """Null, empty, blank, long, repeated and tied rows, with columns that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "Two words", long, "same text of some words here", "same text of some words here", "é ö ß…", "a b c d e f g h i j k l"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 7, 1, "x", 5, 2, "y", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "no id", None, "s1", 5, 7, 1, "x", 5, 2, "y", 0.5), (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def rnd():
    return random.Random(7)
