import random

import pytest

#: Column names that the operators use themselves; documents may have them too.
CLASHES = ["_v", "_q", "s", "u", "score", "key", "n", "packed", "component_id", "n_words", "_id", "text_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdeinorst", k=rnd.randint(2, 8))) + rnd.choice(["", "", ",", ".\n"]) for _ in range(words))


def documents() -> list[tuple]:
    """Nulls, empty and long texts, exact and near copies, shared passages, ties."""
    shared, long = prose(1, 70), prose(2, 6000)
    base = prose(3, 200)
    edited = base.replace(base.split()[100], "CHANGED", 1)
    texts = [None, "", " \n\t", "one", "one two three", base, base, edited, edited + " tail", prose(4, 50) + " " + shared + " " + prose(5, 60), shared + " " + prose(6, 30), prose(7, 40) + " " + shared, long, long + " x", "x " * 300, "é😀ü " * 40, "a" * 200, "b" + "a" * 200, "  nbsp word", base.upper(), "same same same same", "SAME same same same", prose(8, 25), prose(8, 25)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, "en" if i % 2 else None, None if i % 5 == 0 else f"src{i % 4}", len(t or ""), *[f"{c}{i}" for c in CLASHES]))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], (r[1] or "").encode()) for r in documents()]
