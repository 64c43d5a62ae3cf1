import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = [("id", "int"), ("fp", "string"), ("hash", "double"), ("ids", "string"), ("score", "string"), ("predicted", "string"), ("label", "int"), ("copies", "int"), ("n", "int"), ("kept", "string"), ("taken", "int"), ("component_id", "int")]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 977} Über" for k in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (None, "a text without id \n\n\t and \x0b odd   spaces", "fr", "b", None),
        (None, None, None, None, None),
        (None, "another text without id", None, "c", 5),
        (5, "one", "en", None, 3),
        (6, "two words", "en", "c", 9),
        (7, long, "de", "a", len(long)),
        (8, "日本語 テキスト 😀 \x00 ▁ <s> </turn> ###", "ja", "é", 7),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide(odd):
    """Further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(None).cast(t).alias(c) for c, t in EXTRA])
