import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Columns that the operators make themselves, to see that they don't clash.
CLASHES = ("row", "block", "key", "n", "held_out", "target", "copies", "source_size", "words", "hits", "items", "text_")


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(rows)``: a table of (doc_id, text[, lang[, source]]) rows."""

    def make(rows, extra=False):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string").repartition(3)
        if extra:
            df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
        return df

    return make


#: Nulls everywhere, empty and blank texts, ties, repeated rows, text outside ASCII, a long text.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\r\x0b\x0c ", "en", "a"),
    (4, "one", "en", "a"),
    (5, "the cat sat on the mat and the dog lay on the rug", "en", "b"),
    (5, "the cat sat on the mat and the dog lay on the rug", "en", "b"),
    (6, "the cat sat on the mat and the dog lay on the rug", None, None),
    (7, "größe ñandú  nbsp 漢字かな 𝒳 é ΑΒΓ İı ſ", "de", "b"),
    (8, "x " * 5000 + "end", "en", "c"),
    (None, "no id but the same words as another one here", "en", None),
    (9, "no id but the same words as another one here", "en", "c"),
    (10, "12345 --- !!!", "en", "c"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def odd_rows():
    return list(ODD)
