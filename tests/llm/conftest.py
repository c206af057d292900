import random

import pytest

WORDS = "the of and river stone quick brown walks über naïve 学校 под mañana house light never seven water under".split()


def make_texts(n=60, seed=5):
    """Invented texts with copies, near copies, repeated lines, blank and odd ones."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(k))
    out = []
    for _ in range(n):
        out.append("\n".join(sentence(r.randint(3, 25)) for _ in range(r.randint(1, 5))))
    for i in range(0, n, 6):
        words = out[i].split(" ")
        words[r.randrange(len(words))] = "changed"
        out += [out[i], " ".join(words)]
    shared = sentence(30)
    out += [f"{sentence(5)}\n{shared}\n{sentence(6)}" for _ in range(4)] + [shared.replace("the", "The") + "  "]
    return out + [None, "", "   ", "\n\n", "\t\x0b one \x0c two\r", "x" * 5000, "a b " * 3000, "one", "one two"]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with repeated rows, null columns, and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None][i % 2], len(t or ""), "k", 7) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "a", 1, "k", 7), (None, "a null id with some words", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score int")


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return docs.limit(0)
