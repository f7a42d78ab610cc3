import random

import pytest

WORDS = ["the", "of", "und", "que", "la", "in", "Paris,", "été", "naïve", "x1", "日本", "run!", "blue", "green", "stone", "river", "cloud", "seven", "lamp", "quiet"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(500)) if rng.random() < 0.6 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def edited(text, every, seed=0):
    words = text.split(" ")
    for k in range(every - 1, len(words), every):
        words[k] = f"edit{seed}-{k}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and blank texts, repeated rows, repeated ids, and a very long text."""
    base = prose(120, 1)
    rows = [(1, base), (1, base), (2, base), (3, edited(base, 40)), (4, None), (5, ""), (6, " \t\n"), (7, "two words"), (8, "two words"), (9, "one"), (None, base), (None, None), (10, prose(30_000, 2)), (11, "x" * 50_000), (12, "é" * 300 + " ﬁn   <|endoftext|> </s> ▁▁a"), (13, prose(60, 3)), (13, prose(60, 4))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names operators use themselves."""
    names = ["n", "cls", "ids", "n_tokens", "decoded", "score", "predicted", "licences", "found", "blob", "lang", "key", "train", "held_out", "label"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *(["?"] * len(names))) for r in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
