import pytest

#: Rows that every operator on documents must take: nulls in any column, empty, blank and very long texts, repeats, ties.
ODD = [
    (1, "alpha beta gamma delta", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", "b", 4),
    (None, "alpha beta gamma delta", "en", "a", 22), (5, "alpha beta gamma delta", "en", None, 22), (5, "alpha beta gamma delta", "en", None, 22),
    (6, "word " * 60_000, "en", "a", 300_000), (7, "x" * 70_000, "en", "a", 70_000), (8, "Größe élan 梦 😀 " * 8, "fr", "c", 120),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows=None):
        return spark.createDataFrame(ODD if rows is None else [(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def clashing():
    """The same table with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ("y", "fp", "rep", "score", "kept", "size", "target", "key", "k", "rows", "kept_id", "chosen_id", "n_copies", "spans", "label", "held_out", "h", "p", "block")
    return lambda df: df.withColumns({n: F.lit("clash") for n in names})
