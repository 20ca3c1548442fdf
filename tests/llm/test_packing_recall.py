"""Neighbours of a seed are found by all of its terms."""

import base64
import re

import numpy as np
import pytest

from loomspan.llm import packing
from loomspan.llm.packing import K1, VOCABULARY, B, Index, rarest
from tests.llm.conftest import sentence


def scores(tails, idf, mean, seed):
    out = []
    for t in tails:
        tf = {k: int((t == k).sum()) for k in set(t.tolist()) & set(seed.tolist())}
        out.append(sum(idf[k] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(t) / mean)) for k, n in tf.items()))
    return np.array(out)


def test_terms_that_others_hold_count_beside_rarer_ones():
    rare, shared = np.arange(100, 140), np.arange(10, 20)
    tails = [np.append(rare, shared), np.arange(500, 560), np.append(np.arange(700, 740), shared)]
    tails = [t.astype("<u2") for t in tails]
    idf = np.full(VOCABULARY, 9.0)
    idf[10:20] = 2.0
    score = Index(tails, idf, 50.0).neighbours(tails[0], np.array([False, True, True]))
    assert np.argmax(score) == 2 and score[0] == -1 and score[1] == 0


def test_scores_equal_plain_bm25():
    r = np.random.default_rng(4)
    tails = [r.integers(0, 300, n).astype("<u2") for n in r.integers(1, 200, 40)] + [np.array([VOCABULARY - 1, 0], dtype="<u2")]
    idf = r.random(VOCABULARY)
    index = Index(tails, idf, 90.0)
    for seed in tails:
        assert np.allclose(index.neighbours(seed, np.ones(len(tails), dtype=bool)), scores(tails, idf, 90.0, seed))


@pytest.mark.parametrize("shard_rows", [2000, 40])
def test_planted_neighbours_meet_whatever_the_number_of_shards(spark, shard_rows, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(packing, "RANGE_SHARDS", 1)
    r = np.random.default_rng(6)
    common = [sentence(k, 1) for k in range(60)]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        vocabulary = [base64.b64decode(x.split()[0]).decode("utf-8", "replace") for x in lines]
    rare = [w.strip() for w in vocabulary[20_000:] if re.fullmatch(" [a-z]{7,9}", w)][:120]  # one token each
    texts = []
    for k in range(120):
        # two documents of each topic share its word, and nothing else but common ones
        for _ in range(2):
            words = [common[i] for i in r.integers(0, 60, 60)] + [rare[k]] * 3
            texts.append(" ".join(r.permutation(words)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 512).collect()
    rows = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    used, right, asked = set(), 0, 0
    for seed, next_ in zip(rows, rows[1:], strict=False):
        # the first neighbour of a new seed is the other document of its topic, unless an earlier window took that
        if seed["offset"] == 0 and next_["offset"] > 0 and seed["start"] == 0 and seed["doc_id"] ^ 1 not in used:
            asked += 1
            right += next_["doc_id"] == seed["doc_id"] ^ 1
        used.add(seed["doc_id"])
    assert asked > 20 and right >= 0.85 * asked


def test_the_rarest_shared_terms_place_a_tail():
    frequency = np.zeros(VOCABULARY)
    frequency[[5, 6, 7, 8, 9]] = [1, 90, 2, 4, 3]
    assert rarest(np.array([6, 5, 8, 6, 7, 9], dtype="<u2"), frequency) == (7 << 32) + (9 << 16) + 8
    assert rarest(np.array([5, 5], dtype="<u2"), frequency) == 0
