import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["id", "h", "rep", "band", "score", "kept", "n", "minis", "piece", "chunk", "rank", "q", "part", "slot", "label"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        """rows of (doc_id, text[, lang[, source]])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for c in CLASHING:
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty, white space, one word, a very long text, repeated rows, ties."""
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long_text), (5, long_text), (6, "a b c"), (7, "a b c"), (None, "a b c"), (None, None), (8, "é ß 日本 😀"), (9, None, None, None)]
