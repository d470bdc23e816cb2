import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, very long words, extra columns."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (2, base), (3, base.replace("word7 ", "other ")), (4, None), (5, ""), (6, " \n "), (7, "one two"), (8, "ONE two"),
        (None, base), (9, "x" * 50_000), (10, "ab " * 3000), (11, "mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (234) 555-6789 password = hunter22abc"), (12, "日本語 テスト é 😀 " * 30),
    ]
    return spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, n string, key int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
