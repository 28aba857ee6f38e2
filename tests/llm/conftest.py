import random

import pytest

WORDS = "the of and to in is that was for on with as by at from river stone light water house green road paper cloud".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, line: int = 12) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "er", "ing", "s", "ly"]) + str(rng.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="session")
def texts():
    """Texts with the awkward cases: null, empty, white space only, one word, very long, copies, near copies."""
    base = prose(1, 300)
    out = [None, "", " \n\t", "one", "two words", base, base, base.replace("river", "lake", 1), prose(2, 30000), "É ü\x1c x\x0bé", "a\x00b c d e", "x y z " * 200]
    return out + [prose(s, 80) for s in range(10, 40)] + ["shared line of text\n" + prose(s, 60) for s in range(50, 63)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, texts[5], "en", "s", 1)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """The documents with further columns, whose names are those that operators use inside."""
    from pyspark.sql import functions as F

    names = ["__score", "__spans", "__items", "__n_words", "__keep", "__tested", "__row", "__hits", "__lines", "__kept", "__words", "__classes", "__left0", "h1", "fp", "key", "n", "kept", "node", "root", "salt", "rank", "ref_lang", "host", "score"]
    return docs.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(names)))


def key(rows):
    return sorted(map(tuple, rows), key=repr)
