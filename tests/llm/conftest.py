"""Small document tables with every awkward case."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHES = ("text_key", "words", "length", "rank", "key", "batch", "kept", "n_words", "bands", "__words", "task", "label", "tokens")


def sentence(k: int, n: int = 40) -> str:
    """n words that no other k has."""
    return " ".join(f"w{k}x{i}" for i in range(n))


LONG = " ".join(f"long{i % 9000}" for i in range(30_000))


@pytest.fixture(scope="session")
def rows():
    base = sentence(1, 60)
    near = base.replace("w1x59", "other")
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),  # a repeated row
        (3, near, "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, " \n\t ", "de", None),
        (7, "three short words", "de", "b"),
        (8, LONG, "en", "a"),
        (9, sentence(2, 50) + "\n" + sentence(1, 45) + "\n" + sentence(3, 30), "en", "b"),
        (10, 'password=hunter2222 <|endoftext|>  two  blanks é ü "token": abc', "fr", "b"),
        (11, "### " * 30 + sentence(4, 30), "en", "a"),
        (12, "All rights reserved. Licensed under CC BY-NC 4.0. " + sentence(5, 30), "en", "a"),
        (None, sentence(6, 25), None, None),
        (50, sentence(7, 30), "en", "a"),
        (100, sentence(7, 30), "en", "b"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names clash."""
    table = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    for name in CLASHES:
        table = table.selectExpr("*", f"'clash' AS `{name}`")
    return table


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
