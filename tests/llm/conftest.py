import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A small frame in any shape, over several partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


#: Texts that every operator must take: none, empty, short, long, repeated, with clashing column names beside them.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "Ünïcode ß 漢字 \u00a0 e\u0301"), (7, "word " * 5000), (8, "word " * 5000), (8, "word " * 5000), (9, "a" * 20000), (None, "no id here at all"),
    (10, "x\x00y \x1f z\u2028w"), (11, "<|endoftext|> tail<|startoftext|>"), (12, "\U0001f600 emoji \U0001f600"),
]


@pytest.fixture(scope="session")
def awkward(frame):
    return frame([(i, t, "x", "y", 5, 1.0, "z") for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars int, score double, id string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, score double, id string")
