import random

import pytest

ODD = [None, "", " \t\n", "one", "a b c d e", "é😀 ü", "x" * 3000, "\n\n", "A b C d E f", "a b c d e"]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random words, exact and near copies, shared passages, repeated lines, and odd texts."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéf") for _ in range(draw.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared, texts = line(40), []
    for i in range(60):
        lines = [line(draw.randint(3, 40)) for _ in range(draw.randint(1, 5))]
        if i % 7 == 0:
            lines.append(shared)
        if i % 9 == 0:
            lines += [lines[0]] * 3
        texts.append("\n".join(lines))
    for i in range(0, 60, 4):
        copy = texts[i].split(" ")
        for _ in range(i % 3):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    return list(enumerate(texts + ODD))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The same as a table, with columns whose names clash with the operators' own."""
    rows = [(i, t, "src%d" % (i % 3) if i % 5 else None, i, "x", True, 7) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, spans string, kept boolean, size int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
