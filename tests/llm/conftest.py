import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with an extra column whose name clashes with results."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' as kept", "1 as n_words", "2 as row", "'y' as component_id") if extra else df

    return build

