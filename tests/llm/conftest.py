import random

import pytest

VOWELS, REST = "aeiou", "bcdfghlmnprstvz"


class Words:
    """Made-up prose that is the same on each run."""

    def __init__(self, seed):
        self.random = random.Random(seed)
        self.known = ["".join(self.random.choice(REST) + self.random.choice(VOWELS) for _ in range(self.random.randint(1, 4))) for _ in range(900)]

    def text(self, n):
        out = []
        while n > 0:
            size = min(n, self.random.randint(3, 14))
            words = [self.random.choice(self.known) for _ in range(size)]
            out.append(" ".join(words).capitalize() + self.random.choice([". ", ".\n", ", "]))
            n -= size
        return "".join(out).strip()


@pytest.fixture(scope="session")
def prose():
    return Words(7)


@pytest.fixture(scope="session")
def corpus(prose):
    """(doc_id, text): long and short ones, copies, near copies, empty and null texts, repeated rows, a null id."""
    r = prose.random
    docs = [(i, prose.text(r.choice([1, 4, 30, 120, 250]))) for i in range(60)]
    docs += [(60 + i, docs[i][1]) for i in range(0, 12, 3)]
    for i in range(80, 92):
        words = docs[i - 60][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(100, ""), (101, None), (102, "  \n "), (103, " ".join(t for _, t in docs[:20])), (5, docs[5][1]), (None, prose.text(40))]
    return docs


@pytest.fixture
def frame(spark):
    """Documents as a frame, with columns whose names operators use for themselves."""

    def make(rows):
        clash = [(*r, "x", 1, [1], "k") for r in rows]
        return spark.createDataFrame(clash, "doc_id long, text string, row string, key int, spans array<int>, `a.b` string").repartition(3)

    return make
