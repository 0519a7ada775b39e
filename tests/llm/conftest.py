from __future__ import annotations

import random

import pytest

from tests.llm import brute  # noqa: F401

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    """Nulls, empty, blank, long, periodic, tied and repeated rows; shared passages; near copies."""
    rng = random.Random(11)
    base, passage, other = prose(rng, 300), prose(rng, 70), prose(rng, 120)
    words = base.split()
    rows = [(1, None), (2, ""), (3, " \n\t \x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "Ünï cödé ß 𝔘")]
    rows += [(7, base), (8, base), (9, base.upper()), (10, base + " " + base)]
    for i in range(11, 25):
        edited = list(words)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(edited)))
    rows += [(i, f"{prose(rng, 30 + i)} {passage} {prose(rng, 20)}") for i in range(25, 40)]
    rows += [(40, "a" * 3000), (41, "ab" * 900), (42, "run " * 200), (43, "run " * 150 + "x y z")]
    rows += [(44, "p q r " * 120), (45, "\n".join([other] * 3)), (46, other[:700] + "é" + other)]
    rows += [(47, prose(rng, 6000)), (7, base), (7, passage + " tail"), (None, base[:900]), (None, None)]
    rows += [(48, "éß" * 500), (49, "éß" * 400 + "x"), (50, "y" + "éß" * 420), (-3, other)]
    rows += [(51, "\x00ctrl \x1c \x85 \xa0   word"), (52, " ".join(words[:40])), (53, "<|&#*$%> " * 60)]
    rows += [(54, (prose(rng, 9) + "\n") * 9), (55, "A B C " * 3 + "a b c"), (56, " ".join(words[20:280]))]
    return rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    rows = [(i, t, "en", f"s{(i or 0) % 4}" if i != 5 else None, len(t or "")) for i, t in awkward]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same documents with more columns, whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["n_words", "size", "kept", "score", "items", "doc", "node", "base", "spans", "key", "core"]
    return docs.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
