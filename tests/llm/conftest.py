"""Small tables that hold the awkward cases of every operator."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, node long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing extra columns."""
    base = prose(1, 200)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", base, base, base.upper(), " ".join(near), prose(2, 12_000), prose(3, 90)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], None, i, 0.5, 1) for i, t in enumerate(texts)]
    out.append((None, prose(4, 40), "en", "a", 3, None, None, None))
    out.append((6, base, None, None, None, 6, 0.5, 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
