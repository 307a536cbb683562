import os
import sys
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, member string, anchor long"


@pytest.fixture
def frame(spark):
    def make(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty and blank texts, one very long one, odd characters, and repeats."""
    rng = random.Random(3)
    long_text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(30_000))
    return [None, "", " \t\n ", "a", long_text, long_text, "été 日本 😀 ▁x", "x" * 50_000, "a b\u0085c \x0b d", long_text + " tail"]
