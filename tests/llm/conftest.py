"""Small document tables with every awkward case, and real ones cut to a few rows by the tests that need them."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, same string, _row string, _name string, _runs int, epoch int"


def made_documents():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and clashing columns."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(5, 120)) for _ in range(60)]
    base = prose(80)
    copies = [base] * 12
    near = [" ".join([*base.split()[:i], "changed", *base.split()[i + 1:]]) for i in (3, 20, 40, 41, 42, 79)]
    odd = [None, "", "", " ", "a", "a b c", "A b C", "\n\n", "x" * 5000, prose(6000), "é ü ß\nnaïve\ttext", "word", "word", prose(4)]
    spam = ["again " * 300, "again " * 299]
    rows, sources = [], ["web", "books", None, "hot", "hot", "hot"]
    for i, text in enumerate([*texts, *copies, *near, *odd, *spam]):
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(sources), len(text or ""), "clash", "clash", "r", "n", 1, 2))
    rows.append(rows[5])
    rows.append(rows[-2])
    rows.append((None, texts[7], "en", "web", 0, "clash", None, None, "n", None, 3))
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return made_documents()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
