import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, fp long, node string"


def corpus():
    """Small texts of every awkward kind, with copies, near copies and shared passages."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_one = prose(120), prose(3000)
    base = prose(150).split(" ")
    near = [*base]
    near[70] = "changed"
    texts = [prose(60), "", None, "one", "Two  words", prose(40) + " " + passage + " " + prose(30), passage, prose(90) + "\n" + passage, long_one, long_one, " ".join(base), " ".join(near), "x" * 900, "日本語の文 " * 90, "tab\tnew\nline\r\n ok 12,345.6 it's  DON'T", "\x1c\x85 odd 😀 é", prose(30).upper(), "aaaa " * 300]
    texts += [prose(rng.randrange(3, 80)) for _ in range(30)]
    rows = [(n, t, ["en", "de", None][n % 3], [f"s{n % 4}", "https://a.example/x/y", None][n % 3], None, "z", 7, "q") for n, t in enumerate(texts)]
    return rows + [(100, prose(20), "en", "s1", 1, "z", 7, "q"), (200, passage, None, None, None, None, None, None), (None, "no id here at all", "en", "s0", 0, "z", 7, "q")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def twins(spark):
    """Repeated rows: equal in id and text."""
    text = "the same words again " * 30
    return spark.createDataFrame([(5, text, "en", "s", None, "z", 7, "q")] * 2 + [(6, "other " + text, "en", "s", None, "z", 7, "q")], DOCS)
