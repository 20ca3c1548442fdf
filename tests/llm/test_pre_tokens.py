"""Distinct pre-tokens are encoded together, with the tokenizer's own ids."""

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import packing

P = pytest.importorskip("public_tokenizers")
PARTS = ["'", "''", "s", "t", "m", "d", "re", "ve", "ll", "S", " ", "  ", "\n", "\t", "\r", "a", "word", "9", "42", "!", "_", "-", "é", "Ñß", "“", "…", "«", " \n", " '"]
UNUSUAL = ["×", "\x0b", "\x00", "\x1c", "\x85", "\xa0", "語", "😀", "<|endoftext|>"]


@pytest.fixture
def task(monkeypatch):
    """Runs the tokenising step of texts outside Spark and gives the ids of each."""
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: 0})())}))
    packing._tokenizer.cache_clear()

    def run(texts, ranks=P.path("byte_bpe_50k.tiktoken"), rows=1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(x))), pa.array(x, pa.string())], ["doc_id", "text"]) for k in range(0, len(texts), rows) for x in [texts[k : k + rows]]]
        out = [r for b in packing._tokenised(P.path("byte_bpe_50k.json"), ranks, P.PATTERN, 1024, 0)(iter(batches)) for r in b.to_pylist()]
        return [np.frombuffer(r["tail"], dtype="<u2").tolist() for r in out if r["tail"] is not None], np.frombuffer(out[-1]["seen"], dtype="<i4")

    yield run
    packing._tokenizer.cache_clear()


def test_unknown_words_are_encoded_together(task, monkeypatch):
    import tiktoken

    calls, own = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or own(self, text))
    texts = [" ".join(f"w{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(100)) for k in range(20)]
    ids, _ = task(texts)
    assert len(ids) == 20 and len(calls) < 20  # 2,000 distinct words


@pytest.mark.parametrize("ranks", [P.path("byte_bpe_50k.tiktoken"), None])
def test_ids_of_odd_texts_are_the_tokenizers(task, ranks, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE_CHARS", 300, raising=False)
    fast = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    fast.encode_special_tokens = True
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(PARTS if k % 4 else PARTS + UNUSUAL, r.integers(0, 25))) for k in range(1500)] + ["it's", "it'stuff'll've '", "'s's\n's 's", "", " ", "\n\n x \t\n", "'", None]
    expected = [[*fast.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    ids, seen = task(texts, ranks, rows=400)
    assert ids == expected
    count = np.zeros(packing.VOCABULARY, dtype=int)
    for x in expected:
        count[np.unique(x)] += 1
    assert seen.tolist() == count.tolist()
