import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key long, tie string, label double, ids string, "
    "marks string, row string, statistics string, n_tokens string, score string, places string"
)
"""The columns of documents and others with the names that operators use inside."""

WORDS = "the of And tion NDENT über café naïve don't it's 'tis x1 42 idiot 中文 😀 re-do".split()


def text_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\n", ", ", "\t"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null and empty texts, blanks, signs, ties, repeated rows, ids that are null or shared, one very long text."""
    rng = random.Random(7)
    rows = [(i, text_of(rng, rng.randint(1, 120))) for i in range(20)]
    rows += [(20, None), (21, ""), (22, "   "), (23, "\n\n"), (24, "...!?"), (25, "one"), (26, rows[3][1]), (27, rows[3][1])]
    rows += [(28, "a" * 3000), (29, text_of(rng, 20_000)), (3, rows[3][1]), (4, "another text with the same id as four"), (None, "no id"), (None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rest = (None, "src", 1, 5, "t", 0.5, "i", "m", "r", "s", "n", "c", "p")
    return spark.createDataFrame([(i, t, *rest) for i, t in odd_rows()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
