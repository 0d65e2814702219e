import random

import pytest

#: Columns whose names the operators use inside; they must neither clash nor get lost.
EXTRA = "id long, tag string, body string, f long, p long, node long, n long, keep_id long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text) rows with columns of clashing names."""
    def build(rows, parts=3):
        full = [(i, t, 7, "t", "b", 1, 2, 3, 4, 5) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}").repartition(parts)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts that share passages, with nulls, empty and long ones, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    shared = [prose(n) for n in (30, 60, 90)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng.randint(0, 25))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(8)]                    # copies
    for i in range(8):                                                     # near copies
        text = rows[20 + i][1].split(" ")
        text[len(text) // 2] = "changed"
        rows.append((1100 + i, " ".join(text)))
    rows += [(1200, None), (1201, ""), (1202, None), (1203, " \n\t "), (1204, "one"), (1205, "one"),
             (1206, "One two"), (1207, prose(4000)), (1208, "la " * 500), (1209, "la " * 700),
             (1210, "x" * 3000), (1211, "x" * 2000), (None, shared[0]), (1212, shared[0])]
    rows += [rows[0], rows[0], (1201, "")]                                 # repeated rows
    return rows
