import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_data import prose  # noqa: E402


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash."""
    r = random.Random(1)
    long = prose(r, 30_000)
    same = prose(r, 60)
    rows = [
        (1, same, "en", "a", 1, "x"), (2, same, "en", "a", 1, "x"), (3, same.upper(), None, None, None, None), (4, None, "en", "b", 0, "y"), (5, "", "en", None, 0, "y"), (6, " \n\t ", None, "b", 3, "z"),
        (7, long, "en", "c", 9, "z"), (8, long + " tail", "en", "c", 9, "z"), (None, same, "en", "a", 1, None), (None, None, None, None, None, None), (9, "one", "de", "a", 3, "k"), (9, "one", "de", "a", 3, "k"), (10, "漢字 ß 😀 \u0000 é", "fr", "é", 5, "k"),
        (-11, prose(r, 40), "de", "", 5, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, key string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = 12345")
