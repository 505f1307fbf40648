import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside, and others that clash with results.
CLASHING = ["id", "key", "text_", "same", "n", "class_id", "score", "predicted", "held_out", "n_words", "items", "spans", "token", "media", "label", "fold", "row"]


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    """Words with a few frequent ones."""
    return ["".join(chr(97 + (int(rng.paretovariate(0.6)) * k * 7 + k) % 26) for k in range(1, 5)) if rng.random() < 0.4 else f"w{rng.randrange(size)}é" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Ids and texts: unrelated ones, exact and near copies, shared passages, empty, null and very long ones."""
    rng = random.Random(5)
    out: list[tuple[int, str | None]] = []
    base = words(rng, 120, 4000)
    passage = words(rng, 30, 4000)
    for i in range(60):
        out.append((len(out), " ".join(words(rng, rng.randrange(1, 90), 4000))))
    for _ in range(12):
        out.append((len(out), " ".join(base)))
    for k in range(25):
        w = list(base)
        for _ in range(1 + k // 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((len(out), " ".join(w)))
    for _ in range(20):
        w = words(rng, 60, 4000)
        at = rng.randrange(60)
        out.append((len(out), "\n".join([*w[:at], *passage[: rng.randrange(10, 31)], *w[at:]])))
    out += [(len(out) + i, t) for i, t in enumerate(["", None, " ", "a", "a b c", "a b c", "!!! ???", "Ünïcode ÉÉÉ \U0001d11e ▁ tab\tend", " ".join(words(rng, 30_000, 9000)), "x" * 50_000])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else "s", None) for i, t in corpus], DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def clashing(documents):
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
