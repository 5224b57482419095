import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 0, n: int = 120) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, junk, secrets, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "the", "re", "on", "ti", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    rows = []
    for i in range(n):
        text = sentence(rng.randint(1, 200))
        if i % 7 == 3:
            text = f"{text}\n{passage} {sentence(20)}"
        if i % 11 == 5:
            text = rows[i - 5][1]
        if i % 13 == 6 and i > 6 and rows[i - 6][1]:
            text = rows[i - 6][1] + " tail"
        if i % 9 == 4:
            text = "\n".join(["The The The The " + sentence(4)] * 12)
        if i % 10 == 8:
            text = " ".join(w + "%%%" for w in sentence(60).split())
        if i % 17 == 2:
            text += f' token = "{rng.getrandbits(160):040x}" and AKIA{"Q" * 20} Password:\'abc123x\''
        rows.append((i, text, "en", f"src{i % 4}" if i % 23 else None, len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \t\n ", "en", "src0", 4), (n + 3, sentence(9000), "en", "src1", 9), (None, "no id here " * 30, "en", "src0", 3)]
    rows += [rows[10], rows[10]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    found = [(r[0], 0 if r[1] and ("%%%" in r[1] or "The The" in r[1]) else 1, 0) for r in rows if r[0] is not None]
    return spark.createDataFrame(found + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
