import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, score string"


def prose(seed: int, n: int, size: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}x{seed % 7}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns that clash with results."""
    long = prose(3, 30_000, 5_000)
    rows = [
        (1, None, "en", "a", None, 1, "s", "x"),
        (2, "", "en", "a", 0, 1, "s", "x"),
        (3, " \n\t ", None, None, 4, None, None, None),
        (4, "one", "de", "b", 3, 1, "s", "x"),
        (5, "Two words", "fr", "b", 9, 1, "s", "x"),
        (6, prose(1, 60), "en", "b", 9, 1, "s", "x"),
        (7, prose(1, 60), "en", "b", 9, 1, "s", "x"),
        (7, prose(1, 60), "en", "b", 9, 1, "s", "x"),
        (None, prose(2, 50), "en", None, 9, 1, "s", "x"),
        (8, long, "en", "b", 9, 1, "s", "x"),
        (9, "tie tie tie " * 40, "en", "b", 9, 1, "s", "x"),
        (10, "ünï çødé 日本語   mixed\r\nlines\n\nlines\nlines", "de", "b", 9, 1, "s", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def workspace(spark):
    from auditlake.llm.common import Workspace

    own = Workspace(spark)
    yield own
    own.close()
