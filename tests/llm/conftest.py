import pytest


def words(text):
    return (text or "").encode().split()


@pytest.fixture
def rows(spark):
    """documents rows with null, empty and long texts, ties, repeated rows and an extra column."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    data = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("pi", "PI"), "en", "b"),
        (4, None, "en", None), (5, "", "en", "b"), (6, " \t\n ", None, "b"), (7, "one", "en", "c"), (8, "one two three", "en", "c"),
        (9, " ".join(f"w{i * i % 977}" for i in range(30_000)), "en", "a"), (10, base.replace("xi", "chi"), "en", "a"), (11, "Größe  und\nénorme\r\n  x" * 9, "de", "é"),
    ]
    return spark.createDataFrame([(*r, "extra") for r in data], "doc_id long, text string, lang string, source string, _by string")


@pytest.fixture
def empty(rows):
    return rows.limit(0)
