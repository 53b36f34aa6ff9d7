import random

import pytest

WORDS = "the of and river stone lamp garden winter market signal copper window harbour letter engine meadow silver thunder basket candle".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Documents with NULLs, empty, blank, long and repeated texts, repeated keys, and columns with clashing names."""
    rng = random.Random(5)
    long_text = prose(rng, 6000)
    rows = [
        (1, prose(rng, 80), "en"),
        (1, prose(rng, 80), "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "en"),
        (5, long_text, "en"),
        (6, long_text, "fr"),
        (6, long_text, "fr"),
        (None, prose(rng, 60), "fr"),
        (None, None, None),
        (7, "short text", "en"),
        (8, "x" * 50_000, "en"),
        (9, "Ünïcode 日本語 😀 <|endoftext|> \x02 ok " * 30, None),
    ]
    schema = "doc_id long, text string, lang string, kept string, h1 string, t1 int, node int, _key int, k int, t string, score int, block string, doc int"
    return spark.createDataFrame([(*r, "a", "b", 1, 2, 3, 4, "c", 5, "d", 6) for r in rows], schema)


@pytest.fixture
def empty(odd):
    return odd.filter("false")
