import pytest

#: Columns whose names clash with what the operators make, beside the input's own.
CLASHES = ("fp", "key", "score", "h", "s", "node", "statistics", "lang_pred", "start", "n_tokens")


@pytest.fixture(scope="session")
def make(spark):
    """(rows of (doc_id, text), further columns) -> documents with clashing extra columns."""

    def build(rows, lang="en", source="src0"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, lang, source) for i, t in rows], "doc_id long, text string, lang string, source string")
        for c in CLASHES:
            df = df.withColumn(c, F.lit("clash"))
        return df

    return build


ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "A."),
    (4, "12345 !!! ***"),
    (5, "one two three four five six seven"),
    (5, "one two three four five six seven"),
    (None, "a row without an id"),
    (7, "漢字 ßé 😀   \x00 tail"),
    (8, "word " * 30000),
    (9, "x" * 200000),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none_at_all(make):
    return make([]).where("doc_id IS NOT NULL")
