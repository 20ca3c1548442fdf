"""Cover tree: exact links on clustered vectors with most leaf pairs pruned, and odd rows."""

import numpy as np
import pytest

from loomspan.llm.embedding_dedup import CoverTree, embedding_links
from tests.llm.test_dedup import least_reachable


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(30, 24))
    spread = rng.choice([0.04, 0.1], size=(30, 1))
    return np.concatenate([centers[k] + rng.normal(size=(60, 24)) * spread[k] for k in range(30)])


def test_most_leaf_pairs_of_clustered_vectors_are_pruned(clustered):
    unit = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    tree = CoverTree(unit[::2], len(unit), 64)
    cell, distance = tree.cells(unit)
    tree.measure({c: float(distance[cell == c].max()) for c in set(cell.tolist())}, {c: int((cell == c).sum()) for c in set(cell.tolist())})
    compare, within = tree.traverse(np.sqrt(2 - 2 * 0.95))
    used = len(set(cell.tolist()))
    assert used >= 25
    assert len(compare) < used * (used + 1) / 2 / 4
    # every pair that is pruned is too far apart, every pair taken as a whole is near enough
    near = unit @ unit.T
    kept = {tuple(sorted(p)) for p in compare + within}
    for a in set(cell.tolist()):
        for b in set(cell.tolist()):
            part = near[np.ix_(cell == a, cell == b)]
            assert tuple(sorted((a, b))) in kept or part.max() < 0.95
    assert all(near[np.ix_(cell == a, cell == b)].min() >= 0.95 for a, b in within)
    # a ball covers the points of the sample that it was made for
    for node in tree.nodes:
        for c in node.children[:-1]:
            assert tree.nodes[c].level == node.level + 1


def test_links_of_clustered_vectors_equal_brute_force(spark, clustered):
    got = embedding_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered)], "vec_id long, embedding array<double>"), cell_rows=64)
    unit = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = least_reachable(range(len(unit)), list(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True)))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == {i: (int(near[i].sum()) - 1, label[i]) for i in range(len(unit))}


def test_repeated_and_null_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [None, 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, rep int, n int, cell int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_links(df).collect())
    assert got == [(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 3, False), (6, 1, 3, False)]
