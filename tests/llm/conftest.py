import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = "the river ran past the old mill and on through the valley where nobody had lived since the war had come and gone again"


@pytest.fixture
def documents(spark):
    """Odd documents: NULLs, empty and blank texts, repeated rows, a long text, columns with clashing names."""
    rows = [
        (5, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 2),
        (2, PROSE, "en", "a", 2),
        (9, None, "en", "b", 0),
        (10, "", None, None, 0),
        (11, " \n\t ", "en", None, 3),
        (None, "no id here but some words of its own to be read", "en", "b", 4),
        (None, None, None, None, None),
        ((1 << 53) + 1, "an id that no double holds " + PROSE.upper(), "en", "b", 7),
        (12, "word " * 60_000, "en", "a", 300_000),
    ]
    extra = "size long, target double, fp long, component string, copy int, at int, words string"
    return spark.createDataFrame([(*r, 1, 1.0, 1, "x", 1, 1, "y") for r in rows], f"{DOCS}, {extra}")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
