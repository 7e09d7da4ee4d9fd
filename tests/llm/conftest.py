import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n", T.LongType()), ("key", T.StringType()), ("shard", T.LongType()), ("rep", T.StringType()))])
BASE = " ".join(f"word{i} stone{i % 7} river" for i in range(40))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, exact and near copies, repeated rows, and extra columns with clashing names."""
    near = BASE.replace("word20 ", "changed ")
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [BASE, near, BASE, None, "", "", "!!!", "one", long, "Call +44 20 7946 0958 or mail a.b@c.example.org\nfrom 10.0.0.7", "line of plain text\n\nline of plain text", None]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, 5, "k", 3, "r") for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
