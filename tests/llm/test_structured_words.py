"""Words and runs of words that sums of powers can't tell apart: nothing is linked or removed because of them."""

import hashlib

import numpy as np

from loomspan.llm.hashing import Windows, Words, digests, folded
from loomspan.llm.near_dedup import near_duplicates
from loomspan.llm.substring_dedup import without_repeated_windows
from loomspan.llm.suffix_dedup import without_earlier_strings


def thue_morse(n: int, one: str, other: str) -> list[str]:
    return [other if i.bit_count() % 2 else one for i in range(n)]


FIRST, SECOND = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_of_two_letters_differ():
    data = np.frombuffer(f"{FIRST} {SECOND} {FIRST}".encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    for h in (words.hash, words.second()):
        assert h[0] != h[1] and h[0] == h[2]
    assert (words.hash != words.second()).all()


def test_second_hashes_tell_runs_apart():
    a, b = (np.array([3 if x == "a" else 8 for x in thue_morse(2048, *pair)], dtype=np.uint64) for pair in ("ab", "ba"))
    assert Windows(a).each(2048)[0] == Windows(b).each(2048)[0]  # why it can't decide alone
    assert folded(a, 2048)[0] != folded(b, 2048)[0]
    for length in (1, 2, 3, 35, 64):
        both = folded(np.concatenate([a[:70], a[:70]]), length)
        assert len(both) == 141 - length and (both[: 71 - length] == both[70:]).all()
    found = digests(b"abcabd", np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert len({tuple(x) for x in found.tolist()}) == 3


def test_no_false_link_or_removal(spark):
    rest = " ".join(f"w{i}" for i in range(40))
    texts = [FIRST, SECOND, f"{FIRST} x {FIRST}", f"{SECOND} x {SECOND}"]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, texts), 85).collect()}
    assert got == {i: i for i in range(4)}
    texts = [" ".join([x, *rest.split()[:34]]) for x in (FIRST, SECOND)]
    assert [r["n_removed"] for r in without_repeated_windows(frame(spark, texts)).collect()] == [0, 0]
    runs = [" ".join(thue_morse(2048, *pair)) for pair in (("up", "down"), ("down", "up"))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in without_repeated_windows(frame(spark, runs), 1024).collect()}
    words = [r.split() for r in runs]
    seen = [tuple(w[k : k + 1024]) for w in words for k in range(1025)]
    many = {s for s in seen if seen.count(s) > 1}
    for i, w in enumerate(words):
        cut = [False] * 2048
        for k in range(1025):
            if tuple(w[k : k + 1024]) in many:
                cut[k : k + 1024] = [True] * 1024
        assert got[i] == (2048, sum(cut))


def test_no_false_removal_of_bytes(spark):
    pairs = [(f"{FIRST[:512]}{i}", f"{SECOND[:512]}{i}") for i in range(2)]
    texts = [x for pair in pairs for x in pair]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        cut = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 99):
            cut[k : k + 100] |= t[k : k + 100] in seen
            seen.add(t[k : k + 100])
        kept = "".join(x for x, c in zip(t, cut, strict=True) if not c).encode()
        want[i] = (int(cut.sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in without_earlier_strings(frame(spark, texts)).collect()}
    assert got == want
