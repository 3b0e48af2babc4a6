import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    stems = ["the", "of", "and", "river", "stone", "über", "garden", "ciónes", "letter", "window", "morning", "paper", "cold", "bright", "é", "naïve", "market", "street", "winter", "copper"]
    return " ".join(rng.choice(stems) + (rng.choice("abcdefgh") * rng.randint(0, 2) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in any column, empty, blank and long texts, copies, near copies, repeated rows and doc_ids."""
    rng = random.Random(7)
    out = []
    for k in range(60):
        text = "\n".join(words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))
        out.append((k, text, "en", f"s{k % 4}", len(text)))
    long_ = "\n".join(words(rng, 60) for _ in range(80))
    base = words(rng, 150)
    out += [(100, long_, "en", "s1", None), (101, base, "en", "s1", 1), (102, base, "en", "s2", 1), (103, base + " coda", None, None, 2)]
    out += [(104, None, None, "s3", None), (105, "", "en", None, 0), (106, " \n\t ", "en", "", 4), (107, "one", "en", "s2", 3), (108, "One Two", "en", "s2", 7)]
    out += [(109, "same row", "en", "s0", 8)] * 2 + [(110, "a text", "en", "s0", 6), (110, "another text of that id", "en", "s0", 6), (None, base, "en", "s0", 3), (None, "lonely words here", None, "s0", 3)]
    shared = "this line is long enough to be counted as one line of many"
    out += [(120 + k, f"{words(rng, 5)}\n{'  ' if k % 2 else ''}{shared.upper() if k == 3 else shared}\n\nx", "en", "s3", 1) for k in range(6)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators may use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in rows], SCHEMA + ", size int, spans string, score double, component_id string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
