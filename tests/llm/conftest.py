import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, row long, n long, star long"


def prose(rng, n):
    return [rng.choice("re an th ti on in es ou er at".split()) + rng.choice("ba ce di fo gu la me ni po ru".split()) * rng.randint(1, 2) for _ in range(n)]


def make_docs():
    """Copies, near copies by the dozen, passages and lines that many share, junk, and every odd text."""
    rng, out = random.Random(3), []
    passage, line = " ".join(prose(rng, 60)), " ".join(prose(rng, 7))
    base = prose(rng, 120)

    def add(text):
        i = len(out)
        out.append((i, text, "en", f"src{i % 12}" if i % 25 else None, len(text or ""), "x", 1, 2, 3))

    for k in range(120):
        own = prose(rng, rng.randint(60, 200))
        text = " ".join(own[:40]) + "\n" + (line + "\n" if k % 3 else "") + " ".join(own[40:])
        add(text + (" \t" + passage if k % 5 == 0 else ""))
        if k % 10 == 0:
            add(text)
            add(text.upper())
    for k in range(60):  # near copies, also of near copies
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
        add(" ".join(w))
    for k in range(40):
        add(" ".join(x + "###" for x in prose(rng, 80)))
    add(None)
    add("")
    add(" \n\t ")
    add("one two")
    add("One  TWO\n")
    add("a b c d e")
    add(" ".join(["la la la"] * 60))
    add(" ".join(prose(rng, 30_000)))
    add("é ́x zwölf Straße 日本 <|endoftext|> \x1c" + " na" * 60)
    return out


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def scratch(spark):
    from gridloom.llm.store import Scratch

    return Scratch(spark, "test")
