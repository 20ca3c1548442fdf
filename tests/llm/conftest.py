import random

import pytest

WORDS = "alpha beta gamma delta omega river stone cloud green paper winter summer lamp road sea wind tree bird fish hill".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, ties, nulls, empty and very long texts."""
    passage, base = sentence(1, 60), sentence(2, 120)
    texts = [sentence(100 + i, 20 + i) for i in range(12)]
    texts += [base, base, base.replace(base.split()[60], "changed", 1), base + " tail", base.upper()]
    texts += [sentence(200 + i, 15) + " " + passage + "\n" + sentence(300 + i, 15) for i in range(4)]
    texts += [passage + "  " + passage, None, "", "   \n\t", "one two three", "one two three", "Ünï côdé ß " * 30, sentence(5, 9000)]
    texts += [base[:-5] + "x" * i for i in range(6)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = {c: F.lit(1) for c in ("score", "spans", "component", "n", "key", "h", "lang", "source")}
    return plain.withColumns(clashing).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
