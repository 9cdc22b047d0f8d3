from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Seeded texts with copies, edits, shared passages, nulls, empty and odd ones: (doc_id, text)."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abdehilnorstuéß") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = ["\n".join(line(rnd.randint(3, 25)) for _ in range(rnd.randint(1, 8))) for _ in range(14)]
    passage = "\n".join(line(20) for _ in range(3))
    texts = list(base)
    for _ in range(30):
        text = rnd.choice(base)
        if rnd.random() < 0.6:
            parts = text.split(" ")
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
            text = " ".join(parts)
        if rnd.random() < 0.4:
            text = f"{text}\n{passage}\n{line(4)}"
        texts.append(text)
    texts += [None, "", " \t\n\n ", "one", "ONE Two", "a" * 400, "ab" * 300, "x y " * 200, line(9_000), "日本語\nのテキスト\n😀 😀 😀"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The texts as documents with extra columns, some named like an operator's own, and one row twice."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", 7, i) for i, t in corpus]
    rows.append(rows[3])
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, score int, n_words int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
