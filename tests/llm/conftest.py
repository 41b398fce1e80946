import random

import pytest

NASTY = "doc_id long, text string, lang string, source string, n_chars long, k long, s string, g long, block long, copies long, lists string, trusted string, _id long, size int"


def rows_of(texts, ids=None, sources=None):
    """Document rows with extra columns whose names the operators use themselves."""
    return [(ids[i] if ids else i, t, None if i % 5 == 0 else "en", sources[i] if sources else f"s{i % 4}", None, 1, "x", 2, 3, 4, "l", "t", 5, 6) for i, t in enumerate(texts)]


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty and very long texts, copies, near copies, shared passages, ties and odd bytes."""
    r = random.Random(5)
    base = [words(r, r.randint(5, 120)) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = words(r, 1)
            near.append(" ".join(v))
    passage = words(r, 60)
    shared = [f"{words(r, 20)}. {passage}\n{words(r, 10)}" for _ in range(4)]
    odd = [None, "", " ", "\n\n", "one", "one", "Two words", "two WORDS", "ünïcödé ñandú", "a\x00b c\x0bd", "﻿bom  nbsp", "emoji 😀 text 😀 text", "x" * 5000, words(r, 30_000), "same line\n" * 40]
    return base + near + shared + base[:5] + [base[0]] * 6 + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), NASTY).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], NASTY)
