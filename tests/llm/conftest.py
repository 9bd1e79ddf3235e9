import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
#: Texts that stress every operator: null, empty, blanks, ties, copies, odd characters, one long word, one long text.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [None, "", " \t\n ", "one", "one", "Two words", "a b c", "A B C", "a  b\tc\n", "x" * 5000, "é É ſ KK ß",
       "\x00 nul \x1f unit", "| a | b |\n| a | b |\n| a | b |", "same line here\n" * 40, "end.\n\nend.\n\nend.", LONG, LONG + " tail"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null ids, repeated ids, repeated rows, and extra columns whose names operators might use themselves."""
    rows = [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, i) for i, t in enumerate(ODD)]
    rows += [(None, "null id text one two three", None, None, 1), (3, "one", "en", "s1", 2), (3, "other text for id three", "en", "s1", 3),
             (None, None, None, None, None)] + [(4, "one", "en", None, 4)] * 2
    names = "doc_id long, text string, lang string, source string, n_chars long, key long, fp long, n int, w string, size long, component string"
    return spark.createDataFrame([r + (1, 2, 3, "w", 4, "c") for r in rows], names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")
