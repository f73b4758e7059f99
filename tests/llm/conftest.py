import pytest

#: names that operators use inside, and a few that documents may well have
EXTRA = ("n_words", "_text", "_rules", "_quality", "_furniture", "_host", "copies", "size", "place", "node", "band", "_d", "_t", "_jd", "_jn", "_spans", "_items", "score", "kept", "class", "_mix_cut", "_hit")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int = 80) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") + r.choice("stuvw") for _ in range(n))


def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, copies, a very long text."""
    long = prose(9, 30_000)
    return [
        (None, prose(1), "en", "a", 1), (1, None, "en", "a", None), (2, "", None, "b", 0), (3, " \n\t\n ", "de", None, 5),
        (4, prose(2), "en", "a", 9), (4, prose(2), "en", "a", 9), (5, prose(2), "fr", "b", 9), (6, prose(2) + " more", None, None, 9),
        (7, long, "en", "c", len(long)), (8, "x", "en", "c", 1), (9, "é𝔘" * 40, "en", "c", 80), (10, "same " * 200, "en", "c", 1000),
        (10, prose(3), "en", "c", 1000), (11, "line\n" * 30 + prose(4), "en", "a", 10), (None, None, None, None, None),
        (12, prose(5) + " password=abcdef123456 " + "0a" * 20, "en", "a", 10),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def crowded(spark, odd):
    """The odd rows with further columns whose names clash."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(4, 12)), (None, prose(5, 6)), (2, None), (3, ""), (1, prose(4, 12)), (4, "Same same")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 1, 0), (8, 0, 1), (10, 0, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
