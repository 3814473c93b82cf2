import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, name string, v string, label string, rank int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, and a null id."""
    long = prose(1, 30_000)
    base = prose(2, 60)
    near = base.replace(base.split(" ")[30], "changed", 1)
    texts = [
        (0, base, "en"), (1, base, "en"), (1, base, "en"), (2, near, "en"), (3, base.replace(" ", " \n\t "), None), (4, "", "en"), (5, None, None), (6, " \n ", "de"),
        (7, long, "en"), (8, long, "en"), (9, long + " tail", "en"), (10, "12 34 !?", "en"), (None, prose(3, 40), "fr"), (None, None, None), (11, "über ßtraße çé 漢字", "de"),
        (12, "one two three", "en"), (13, "one two three", "en"),
    ]
    return [(i, t, lang, None if i == 3 else "s", None, "d", "n", "v", "l", 1) for i, t, lang in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
