import pytest
from pyspark.sql import Row

TEXT = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one. "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, shared ids, and columns that clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, TEXT), (2, None), (3, ""), (4, " \t\n"), (5, TEXT), (5, TEXT), (6, TEXT.upper()), (7, "a b"), (8, "a  b"), (None, TEXT), (9, long), (10, TEXT + TEXT),
        (11, "naïve café — ünï  <|endoftext|> x\n\n\ty \U0001f600"), (12, "un " * 200), (7, "another text under a taken id"),
    ]
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", component_id="clash", kept=7, hash=1, anchor="x", spans=0, n=3, rep=1, host="h") for i, t in rows], "doc_id long, text string, lang string, component_id string, kept int, hash int, anchor string, spans int, n int, rep int, host string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
