from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

for folder in Path(__file__).resolve().parents[:2]:
    sys.path.insert(0, str(folder))

SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Ids and texts: copies, near copies, shared passages, blanks, nulls, one very long text, odd white space."""
    base, passage = prose(1, 300), prose(2, 80)
    edited = base.split()
    edited[50] = edited[200] = "changed"
    texts = [base, base, " ".join(edited), base.upper(), passage, passage + " " + prose(3, 40), prose(4, 60) + "\n" + passage]
    texts += [passage + " " + passage, "", None, " \t\n ", "one two", "One two", "one two", "\x1cone two", prose(5, 49), prose(5, 49), prose(6, 20_000)]
    texts += [" ".join(base.split()[:250]), " ".join(["same"] * 200), " ".join(["same"] * 120), "é " * 70, prose(7, 50), prose(7, 51)]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture()
def odd_docs(spark, odd_texts):
    """The texts with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None, 1, "x") for i, t in odd_texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, mark int, `group` string"
    ).repartition(3)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
