import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band long, score string"


def passage(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Null and empty texts, nulls elsewhere, a long text, repeated rows, copies, near copies, shared passages, personal data."""
    rng = random.Random(5)
    base, shared, long_text = passage(rng, 120), passage(rng, 60), passage(rng, 9000)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", "  \n\t ", "word", base, base, base.upper(), near, f"{passage(rng, 40)} {shared} {passage(rng, 10)}", f"{passage(rng, 30)} {shared}", long_text, "a b c", "a b c", "ab " * 300]
    texts += [f"{passage(rng, 50)} mail joe.x@mail.example.com now, 10.20.30.40 or +1 (555) 555-1234; 4111 1111 1111 1111", "@@ a@b 1.2.3 999.1.1.1 + +1 1-1"]
    texts += [passage(rng, rng.randint(1, 80)) for _ in range(20)]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 else "src0", None if k % 5 == 0 else len(t or ""), k, "x") for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], rows[0], rows[11]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
