"""Rows that repeat a doc_id, with the same text and with others, and null doc_ids."""

import hashlib

import pytest

from loomspan.llm.substring_dedup import cut_repeated_windows, without_repeated_windows
from loomspan.llm.suffix_dedup import without_earlier_strings
from tests.llm.conftest import sentence
from tests.llm.test_dedup import brute_windows

LONG, OTHER = sentence(21, 80), sentence(22, 60)
ROWS = [(1, LONG), (2, LONG), (2, "short"), (2, OTHER), (3, OTHER), (3, OTHER), (None, LONG + " end"), (None, OTHER + " end"), (None, None), (4, None), (5, "")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, h string, start int").repartition(2)


def test_every_row_is_a_text_for_windows(repeated):
    words, gone = brute_windows(list(enumerate(t for _, t in ROWS)), 35)
    kept = [" ".join(w for w, g in zip(words[k], gone[k], strict=True) if not g) for k in range(len(ROWS))]
    want = [(d or 0, len(words[k]), sum(gone[k]), hashlib.sha256(kept[k].encode()).hexdigest()) for k, (d, _) in enumerate(ROWS)]
    got = [(r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in without_repeated_windows(repeated).collect()]
    assert sorted(got) == sorted(want)
    cut = cut_repeated_windows(repeated)
    assert cut.columns == repeated.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in cut.collect()) == sorted((d or 0, kept[k] if any(gone[k]) else t or "") for k, (d, t) in enumerate(ROWS))


def test_rows_that_repeat_id_and_text_are_one_document_for_bytes(repeated):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in without_earlier_strings(repeated).collect())
    a, b = len(LONG), len(OTHER)
    # the null rows stand first; every later copy goes, and of the two texts of document 2 none repeats the other
    assert got == sorted([(0, a + 4, 0), (0, b + 4, 0), (0, 0, 0), (1, a, a), (2, a, a), (2, 5, 0), (2, b, b), (3, b, b), (3, b, b), (4, 0, 0), (5, 0, 0)])
