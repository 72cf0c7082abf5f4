import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, probability double, class_id long, rep long, doc long, weight double"


def make_words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that operators use inside."""
    rng = random.Random(5)
    plain = make_words(rng, 120)
    rows = [
        (1, plain, "en", "a"), (2, plain, "en", "a"), (2, plain, "en", "a"), (3, "", "en", None), (4, None, None, "a"), (None, plain + " tail", "de", "b"), (None, None, None, None),
        (5, make_words(rng, 30_000), "fr", "a"), (6, "  \n\t ", "en", "b"), (7, "one", "en", "b"), (8, "É ß 日本語 😀 ́x", "xx", "c"), (9, "the\n" * 500, "en", "a"), (10, make_words(rng, 200) + "\n" + make_words(rng, 40), "en", "c"),
        (11, "a" * 400, "en", "c"), (12, plain.replace("a", "A"), "en", "c"),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 1.0, 0.5, 7, 8, 9, 1.0) for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(seed: int, n: int) -> str:
    return make_words(random.Random(seed), n)
