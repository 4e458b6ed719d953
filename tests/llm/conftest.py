import random

import pytest

WORDS = [f"{a}{b}" for a in "th er on an re he in ed nd ha".split() for b in "at en es of ti wh ou ly sh or".split()]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows with nulls, empty and long texts, copies, near copies and shared passages."""
    r = random.Random(4)
    base = [prose(r, r.randint(1, 160)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    shared = prose(r, 60)
    for i in range(100, 108):
        rows.append((i, prose(r, 30) + "\n" + shared + " " + prose(r, 10)))
    for i in range(200, 206):
        rows.append((i, base[i % 10]))  # exact copies
    for i in range(300, 312):  # near copies
        words = prose(random.Random(9), 120).split()
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One two"), (404, "one TWO"), (405, "a b " * 3000), (406, "word"), (407, "ÄÖ ß x " * 20), (None, base[0]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names clash with those used inside."""
    rows = [(i, t, "en", f"s{k % 3}", k, "x") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ID string, __verdicts long, label string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
