import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs."""

    def build(rows, extra=""):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded invented prose with copies, edited copies, shared passages, nulls, empty and long texts, and repeated rows."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = words(70)
    rows = [(i, words(r.randint(0, 160))) for i in range(60)]
    rows += [(60 + i, f"{words(r.randint(0, 40))} {passage[: r.randint(300, 420)]}\n{words(r.randint(0, 40))}") for i in range(25)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    for i in range(10):
        edited = rows[50 + i][1].split(" ")
        if edited:
            edited[len(edited) // 2] = "changed"
        rows.append((120 + i, " ".join(edited)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "a " * 30_000), (205, words(9000)), (None, rows[3][1]), (3, rows[3][1])]
    return rows
