"""A small table of documents with nulls, empty, long, equal and near-equal texts, and clashing column names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, shard int, key string"
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


def rows() -> list[tuple]:
    texts = [words(i, 20 + i) for i in range(30)]
    near = words(100, 200).split()
    for i in range(6):  # near copies of one text
        copy = list(near)
        copy[10 * i + 3] = "changed"
        texts.append(" ".join(copy))
    texts += [words(200, 40)] * 14  # copies of one text
    texts += [f"{words(300, 30)} {PASSAGE} {words(301, 30)}", f"{words(302, 10)} {PASSAGE}", f"{PASSAGE}\n{words(303, 25)}"]
    texts += [None, "", None, "   ", "x", "Ünïcödé \U0001f600 naïve", "<|endoftext|> a's <|startoftext|>", words(400, 3000)]
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), i, "r", 1, "k") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "no id", "en", "src0", 5, 0, "r", 1, "k"), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
