import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, n BIGINT, fp STRING, tokens STRING, share INT"
PROSE = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(400))


def rows_of(texts):
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "k", 1, "f", "t", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and very long texts, copies, near copies, repeated rows, columns of names that operators use."""
    near = PROSE.split(" ")
    near[200] = "changed"
    texts = [PROSE, None, "", "   \n\t ", "one", "one two", "ONE two", "a b c d e", PROSE, " ".join(near), "x" * 300_000, "long " * 60_000]
    texts += ["Licensed under the MIT License.", "café <|endoftext|> 你好", None, "one two", PROSE.upper()]
    rows = rows_of(texts)
    rows += [rows[5], rows[0]]  # rows that occur twice
    rows += [(None, "no id", None, None, None, None, None, None, None, None), (None, PROSE, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
