import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, base int, ids int, key string, hub int, id int, n int, w int, terms int"


def padded(rows):
    """(doc_id, text) with extra columns whose names the operators use themselves."""
    return [(i, t, None, "s", None, "x", "x", 1, 2, "k", 3, 4, 5, 6, 7) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, clashing columns."""
    from hyperweave.llm.common import ship

    ship(spark)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here a@b.co"), (4, long), (5, "x" * 30_000), (6, "short text"), (6, "short text"), (7, "two\nlines of MIT License text"), (8, "mail a@b.co or +1 (301) 555-0346")]
    rows += [(10 + k, t) for k, t in enumerate(prose)] + [(30 + k, t) for k, t in enumerate(prose[:5])]
    rows += [(40 + k, " ".join([*t.split()[:-1], "changed"])) for k, t in enumerate(prose)]
    rows += [(60 + k, f"{words[k]} {prose[k % 3]} {words[-k]}") for k in range(12)]
    return spark.createDataFrame(padded(rows), SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], SCHEMA)
