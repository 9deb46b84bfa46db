from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_text(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "ti", "re", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows, control strings."""
    rng = random.Random(7)
    base = [make_text(rng, n) for n in (3, 40, 80, 120, 200)]
    passage = make_text(rng, 60)
    texts = [None, "", " ", "one", "tiny text", *base, base[2], base[2], base[3].replace("an", "an", 1) + " extra", passage]
    texts += [make_text(rng, 30) + " " + passage + " " + make_text(rng, 30) for _ in range(4)]
    texts += ["aaaa " * 400, "x" * 5000, make_text(rng, 4000), "UNDER the MIT license!", "Apache License, Version 2.0 and cc-by-nc"]
    texts += ["<|im_end|><|im_start|>assistant ok", "tab\tnew\nline\x00null \U0001f600", "licensed under the mut license"]
    rows = [(i * 3 % 101, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[1], None, None, None), (500, base[4], None, None, 5), (500, base[4], None, None, 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
