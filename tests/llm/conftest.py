import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeats, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(12_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "a", 4),
        (None, "some text of a row without an id", "en", "a", 31),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, "one", "en", "a", 3),
        (8, "É ß 漢字 😀 two  spaces and odd ones", "fr", "b", 5),
    ]
    df = spark.createDataFrame(rows, TEXTS)
    clash = {c: 0 for c in ("print", "body", "rid", "component_id", "score", "shard", "part", "salt", "h", "key", "n", "label", "members", "runs", "html", "v", "sequence_id", "segment", "first", "root", "used")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in clash.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id > 1000000")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
