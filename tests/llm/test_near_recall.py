"""Recall of the chosen-path trees on planted pairs near the threshold, and rows that repeat an id."""

import random

from loomspan.llm.near_dedup import near_duplicates, one_of_each_group
from tests.llm.conftest import sentence
from tests.llm.test_dedup import shingles


def test_planted_pairs_near_the_threshold_are_linked(spark):
    r, rows, planted = random.Random(8), [], []
    base = sentence(4000, 300).split()
    for k in range(600):
        # every other pair stands in one hot near group below the threshold, the rest alone
        words = sentence(k, 300).split() if k % 2 else [w if r.random() > 0.03 else w + str(k) for w in base]
        other = list(words)
        for at in r.sample(range(300), 4):
            other[at] = f"changed{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = (shingles(t) for _, t in rows[-2:])
        if 100 * len(a & b) >= 85 * len(a | b):
            planted.append((2 * k, 2 * k + 1))
    sets = {i: shingles(t) for i, t in rows}
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()}
    found = sum(got[a] == got[b] for a, b in planted)
    assert len(planted) > 300 and found >= 0.99 * len(planted)
    # no false link: everything in a component is reached over pairs at the threshold
    for i, c in got.items():
        if c != i:
            group = [j for j in got if got[j] == c and j != i]
            assert any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in group)


def test_one_row_of_each_group_stays(spark):
    text, other = sentence(1, 40), sentence(2, 40)
    rows = [(3, text), (2, text), (2, text), (2, other), (None, text), (None, other + " more words at the end"), (None, None), (None, ""), (5, ""), (5, ""), (6, sentence(3, 40))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, n int")
    left = one_of_each_group(docs, 80)
    assert left.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert got == sorted([(2, text), (2, other), (0, ""), (0, ""), (5, ""), (6, rows[-1][1])])
