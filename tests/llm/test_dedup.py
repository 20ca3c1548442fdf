"""The duplicate finders against brute force on a small corpus with every odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import near_dedup, suffix_dedup
from loomspan.llm.embedding_dedup import embedding_links
from loomspan.llm.near_dedup import near_duplicates
from loomspan.llm.substring_dedup import cut_repeated_windows, without_repeated_windows
from loomspan.llm.suffix_dedup import maximal_repeats, prefix_intervals, without_earlier_strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def least_reachable(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


@pytest.mark.parametrize(("small", "node_rows"), [(24, 20_000), (0, 20_000), (0, 3)])
def test_near_duplicates(docs, rows, small, node_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "NODE_ROWS", node_rows)
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", 3)
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = least_reachable(sets, linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 85).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_nothing_and_nulls(spark, no_docs):
    assert near_duplicates(no_docs, 85).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(odd, 85).collect()) == [(0, 0, False), (4, 4, True), (4, 4, True)]


def brute_windows(rows, width):
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    gone = {}
    for i, w in words.items():
        cut = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                cut[k : k + width] = [True] * width
        gone[i] = cut
    return words, gone


@pytest.mark.parametrize(("width", "gram"), [(35, 9), (7, 3), (4, 4)])
def test_repeated_windows(docs, rows, width, gram):
    words, gone = brute_windows(rows, width)
    digest = lambda i: hashlib.sha256(" ".join(w for w, g in zip(words[i], gone[i], strict=True) if not g).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in without_repeated_windows(docs, width, gram).collect()}
    assert got == {i: (len(words[i]), sum(gone[i]), digest(i)) for i in words}


def test_cut_texts_keep_all_columns(docs, rows, no_docs):
    words, gone = brute_windows(rows, 35)
    cut = cut_repeated_windows(docs)
    assert cut.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {i: " ".join(w for w, g in zip(words[i], gone[i], strict=True) if not g) if any(gone[i]) else t for i, t in rows}
    assert cut_repeated_windows(no_docs).count() == 0


@pytest.mark.parametrize("hot", [400, 1])
def test_earlier_strings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    width, seen, want = 40, set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cut = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                cut[k : k + width] = True
            seen.add(b[k : k + width])
        runs = int((cut[:1]).sum() + (cut[1:] & ~cut[:-1]).sum())
        want[i] = (len(b), int(cut.sum()), runs, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in without_earlier_strings(docs, width, 16).collect()}
    assert got == want


def test_prefix_intervals_and_maximal_repeats():
    assert sorted(prefix_intervals([0, 3, 5, 5, 2, 4], 3)) == [(0, 3, 3), (1, 3, 5), (4, 5, 4)]
    found = [(n, sorted(places)) for n, places in maximal_repeats([b"xxabcdyy", b"zzabcdyw", b"qabcq"], [9, 9, 9], 3)]
    assert sorted(found) == [(3, [(0, 2), (1, 2), (2, 1)]), (5, [(0, 2), (1, 2)])]


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    vectors = [list(map(float, centers[i % 6] + rng.normal(size=8) * (0.02 if i % 2 else 0.4))) for i in range(80)]
    vectors += [vectors[0], vectors[0], [0.0] * 8, [float("nan")] * 8, None, [1.0, None] + [0.0] * 6, []]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors[:82]) / np.linalg.norm(vectors[:82], axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = least_reachable(range(len(vectors)), [(a, b) for a in range(82) for b in range(a) if near[a, b]])
    assert got == {i: (int(near[i].sum()) - 1 if i < 82 else 0, label[i], label[i] == i) for i in range(len(vectors))}
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
