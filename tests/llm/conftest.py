import pytest
from pyspark.sql import types as T

#: Columns that the operators don't know, named like what they use inside.
CLASHING = ["size", "target", "root", "node", "t", "n", "line", "words", "hash", "key", "label", "features", "score",
            "row", "pos", "h", "first", "own", "part", "token", "a", "b", "id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, source]) as a documents table with clashing extra columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])

    def make(rows):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        return spark.createDataFrame([(d, x, "en", s, len(x or ""), *CLASHING) for d, x, s in rows], schema)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated, tied, very long and non-ASCII texts; null and repeated ids."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    word = "x" * 600_000
    base = " ".join(f"base{i}" for i in range(120))
    near = base.replace("base60 ", "other60 ")
    return [(1, None, "s"), (2, "", "s"), (3, " \t\n ", None), (4, base, "s"), (5, near, "s"), (6, base, "r"),
            (6, base, "r"), (7, "Two words", "r"), (8, "two WORDS", None), (9, long, "q"), (10, long + " tail", "q"),
            (11, word, "q"), (None, "no id here at all, none", "s"), (None, None, None), (12, "Élan K İx ßx ué", "é"),
            (7, "same id other text entirely different", "r"), (13, "a\n\nb\na\n", "s"), (14, "...!!!", "s")]
