"""Rows with every odd case, for all text operators."""

import random

import pytest

RNG = random.Random(11)
ODD_SCHEMA = (
    "doc_id long, text string, source string, id string, _text string, _raw string, _key string, spans string, "
    "n int, form string, output string, mask int, part string, digest string, _spans string"
)


def prose(n, rng=RNG):
    words = [a + b for a in "ba ce di fo gu".split() for b in "la me ni po ru st".split()]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_texts():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, one id with several texts."""
    base = prose(80)
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base, None), (4, None, "b"), (5, "", "b"), (6, "", None),
        (7, " \n\t ", ""), (None, base, "a"), (None, base, "a"), (None, None, None), (8, "one two", "a"),
        (8, "other text of the same id", "a"), (9, "ÀÉ 漢字 😀 é‍ x" * 5, "c"), (10, prose(30_000), "c"),
        (11, "LOUD AND SHORT!", "a"), (12, "a | b & c", "a"), (13, "has <P> and <S> and <M>", "b"), (14, "<P", "b"),
        (15, "S>x<M", "b"), (-3, "x", "d"), (2**62, "y" * 70, "d"),
    ]
    rows += [(100 + i, prose(RNG.randint(0, 90)) + RNG.choice(["", " #", " ABC DEF GHI"]), RNG.choice("abc")) for i in range(60)]
    rows += [(200 + i, RNG.choice(["same text", "same | text"]), RNG.choice(["a", None])) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return odd_texts()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rest = ("i", "t", "r", "k", "s", 1, "f", "o", 2, "p", "d", "q")
    return spark.createDataFrame([(*r, *rest) for r in odd_rows], ODD_SCHEMA).repartition(3)
