"""Small tables that the operators' tests share."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary() -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(900)]


@pytest.fixture
def make(spark):
    def build(texts, ids=None, extra=False):
        rows = [(k if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            # names that operators use themselves
            df = df.withColumns({c: F.lit(f"x-{c}") for c in ("h", "words", "w", "p", "fp", "score", "component_id", "piece", "length", "v", "pos", "n", "item", "y", "draw", "_removed2", "text2")})
        return df

    return build
