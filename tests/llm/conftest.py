from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, of: int = 400) -> str:
    """Made-up words in lines of about eight."""
    out = []
    for i in range(words):
        out.append("".join(rng.choice(["ta", "re", "mon", "sil", "vo", "ku", "és", "ing"]) for _ in range(1 + rng.randrange(of) % 3)))
        out.append("\n" if i % 8 == 7 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, repeats, near copies and ties."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split(" ")
    rows = [
        (1, base), (2, base), (3, base), (3, base),
        (4, None), (5, ""), (6, " \n "), (7, "one"), (8, "one"), (9, "ONE"), (10, "!!! 12 ..."),
        (None, base), (None, "only this row"), (None, None),
        (11, prose(rng, 9_000)), (12, "x" * 70_000), (13, "a b c d " * 3_000),
        (14, "two texts of one id"), (14, "the other text of that id"),
        (15, "line\nline\nline\nline\nline"), (16, "\n\n\n\n"), (17, "\n\n\n\n"),
    ]
    for i in range(60):
        changed = list(words)
        for _ in range(i % 6):
            changed[rng.randrange(len(changed))] = f"new{i}"
        rows.append((100 + i, " ".join(changed)))
    rows += [(300 + i, prose(rng, 20 + 3 * i)) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, "aa" if k % 2 else "bb", "src", len(t or "")) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "score", "lang_pred", "n_lines", "n_removed", "key_hash", "size", "node", "ids", "terms", "lines"]
    return odd_docs.withColumns({name: F.lit("mine") for name in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
