import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def frame(spark):
    """A documents table out of (doc_id, text[, source]) with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "x", [1]) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, n_words int, key string, spans array<int>")

    return make


def pytest_generate_tests(metafunc):
    if "hard_text" in metafunc.fixturenames:
        metafunc.parametrize("hard_text", HARD, ids=range(len(HARD)))


HARD = [
    "",
    " ",
    "\n\n",
    "a",
    "The the THE.",
    "don't they'll 'S",
    "  two  blanks\tand\ttabs\r\n",
    "é è ü ß Σ ς İ ﬁ ½ ² 漢字 🙂🙂 ‍",
    "é combining",
    "<|endoftext|> in <|im_end|> text<|endoftext|>",
    "x" * 700,
    "ab" * 3000 + " " + "!" * 300,
    "\x1c\x85　 odd blanks",
    "word " * 4000,
]
