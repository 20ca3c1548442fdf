"""Second, plain versions of the classifier, the k-d tree, decontamination and the pipeline."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, quality
from loomspan.llm.kd_shards import DIMS, kd_shards, points
from loomspan.llm.repeats import identified
from tests.llm.conftest import sentence
from tests.llm.test_dedup import brute_windows, least_reachable, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def plain_ftrl(rows, share):
    z, n, bz, bn = {}, {}, 0.0, 0.0
    weight = lambda zi, ni: 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for features, label in rows:
            w = {i: weight(z.get(i, 0.0), n.get(i, 0.0)) for i in features}
            bias = -bz * quality.ALPHA / (quality.BETA + math.sqrt(bn))
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in features.items()) - bias))
            miss = share[label] ** -0.5 * (p - label)
            for i, v in features.items():
                g = miss * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bz += miss - (math.sqrt(bn + miss * miss) - math.sqrt(bn)) / quality.ALPHA * bias
            bn += miss * miss
    return {i: weight(z[i], n[i]) for i in z}, -bz * quality.ALPHA / (quality.BETA + math.sqrt(bn))


def test_classifier_equals_plain_ftrl(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    place = {r["doc_id"]: r["p"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("p")).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def features(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        (index, value), = quality.features(raw, np.array([0, len(raw)]))
        return dict(zip(index.tolist(), value.tolist(), strict=True))

    # the features are single tokens and pairs of neighbours, counted by another tokeniser
    for text in list(texts.values())[:20]:
        tokens = re.findall(r"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-\x7f]+", text.encode().decode("latin-1"))
        pairs = {(a, b) if a != b else "repeated" for a, b in zip(tokens, tokens[1:], strict=False)}
        assert len(features(text)) <= len(set(tokens)) + len(pairs) <= 1.02 * len(features(text)) + 5  # but for collisions
        assert not tokens or sum(v * v for v in features(text).values()) == pytest.approx(1)
    used = [r for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts]
    used.sort(key=lambda r: (place[r["doc_id"]], r["doc_id"]))
    share = [max(1, sum(r["quality"] == k for r in used)) * 2 / len(used) for k in (0, 1)]
    weights, bias = plain_ftrl([(features(texts[r["doc_id"]]), r["quality"]) for r in used], share)
    for r in quality.quality(docs, labels).collect():
        s = sum(weights.get(i, 0.0) * v for i, v in features(texts[r["doc_id"]]).items()) + bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-5)


def test_labels_that_contradict_each_other_give_one_result(spark):
    docs = spark.createDataFrame([(i, sentence(i, 20) + (" good" if i % 2 else " bad")) for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i in range(1, 40) for k in (i % 2, (i // 3) % 2)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    first, second = ({r["doc_id"]: r["score"] for r in quality.quality(docs, part).collect()} for part in (labels, labels.orderBy(F.desc("quality")).repartition(3)))
    assert first == second


@pytest.mark.parametrize(("sf", "shards", "off"), [("sf0.1", 40, 0.05), ("sf0.01", 7, 0.2)])
def test_shards_are_a_kd_tree_of_weighted_medians(spark, sf, shards, off):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = kd_shards(docs, shards).select("doc_id", "shard")
    rows = points(docs).join(got, "doc_id").toArrow().to_pydict()
    keys, shard, size = np.array([rows[f"k{i}"] for i in range(DIMS)]), np.array(rows["shard"]), np.array(rows["size"])

    def check(first, owed):
        mine = (shard >= first) & (shard < first + owed)
        if owed == 1:
            return
        widest = max(range(DIMS), key=lambda i: int(keys[i][mine].max()) - int(keys[i][mine].min()))
        left = mine & (shard < first + owed // 2)
        assert keys[widest][left].max() < keys[widest][mine & ~left].min()
        assert abs(size[left].sum() - size[mine].sum() * (owed // 2) / owed) <= size[mine].max()
        check(first, owed // 2)
        check(first + owed // 2, owed - owed // 2)

    check(0, shards)
    load = np.bincount(shard, weights=size, minlength=shards)
    assert abs(load / load.mean() - 1).max() < off


def test_shards_of_odd_rows(spark):
    copies = [(i, "the same text") for i in range(600)]
    rows = [*copies, (None, "x"), (None, None), (5, "other"), (5, "other"), (5, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, k0 int")
    got = kd_shards(docs, 6).collect()
    assert len(got) == len(rows)
    counts = np.bincount([r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"the same text")], minlength=6)
    assert counts.min() > 60  # a group of copies is dealt over all shards
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def plain_template(text):
    """(code, filler) of each template word of a text, by regular expressions."""
    out, end, before_number, kind_before = [], None, False, None
    raw = (text or "").encode().decode("latin-1")
    for m in re.finditer(r"[0-9A-Za-z\x80-\xff]+", raw):
        word = m[0].translate({c: c + 32 for c in range(65, 91)})
        number = m[0][0].isascii() and m[0][0].isdigit()
        name = "A" <= m[0][0] <= "Z" or (m[0][0] == "\xc3" and raw[m.start() + 1 : m.start() + 2] <= "\x9e")
        unit = not number and before_number and word in decontaminate.UNITS
        gap = raw[end : m.start()] if end is not None else None
        kind = "#" if number else "N" if name else "U" if unit else None
        joined = kind is not None and kind == kind_before and gap is not None and ((kind == "N" and not gap.strip(" \t\n\r\f\v")) or (kind == "#" and gap in (".", ",")))
        if joined:
            out[-1] = (kind, (*out[-1][1], word))
        else:
            out.append((kind or word, (word,)))
        end, before_number, kind_before = m.end(), number, kind
    return out


def plain_holds(doc, item, width=5, share=80, consistent=80):
    if not item or not doc:
        return False
    if len(item) < width:
        return [f for _, f in doc] == [f for _, f in item]
    key = lambda t, k: tuple(f for _, f in t[k : k + width]) if all(c in "#NU" for c, _ in t[k : k + width]) else tuple(c for c, _ in t[k : k + width])
    at = {}
    for k in range(len(item) - width + 1):
        at.setdefault(key(item, k), []).append(k)
    hits = sorted((d - k, k) for d in range(len(doc) - width + 1) for k in at.get(key(doc, d), ()))
    groups = []
    for shift, k in hits:
        if not groups or shift - groups[-1][-1][0] > width:
            groups.append([])
        groups[-1].append((shift, k))
    for group in groups:
        counts = {}
        for shift, _ in group:
            counts[shift] = counts.get(shift, 0) + 1
        answer = {}
        for shift in sorted(counts, key=lambda s: (counts[s], s)):
            answer.update({k + j: k + j + shift for s, k in group if s == shift for j in range(width)})
        if len(answer) * 100 < share * len(item):
            continue
        pairs = {}
        for a, d in answer.items():
            if item[a][0] in "#NU":
                pairs[item[a][0], item[a][1], doc[d][1]] = pairs.get((item[a][0], item[a][1], doc[d][1]), 0) + 1
        left, right, agreeing = set(), set(), 0
        for (c, a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1] != x[0][2])):
            if (c, a) not in left and (c, b) not in right:
                left.add((c, a))
                right.add((c, b))
                agreeing += n
        if agreeing * 100 >= consistent * sum(pairs.values()):
            return True
    return False


def test_held_items_equal_the_plain_search(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: plain_template(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], k) for r in docs.collect() for t in [plain_template(r["text"])] for k, item in items.items() if plain_holds(t, item)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want and want


ITEM = "In 1990 the farmer Anna sold 12 kg of apples to Peter for 30 dollars and went home by train"


@pytest.mark.parametrize(("text", "held"), [
    (ITEM, True),
    (ITEM.replace("1990", "2011").replace("Anna", "Maria").replace("12", "77").replace("Peter", "John").replace("30", "5"), True),
    (ITEM.replace("Anna", "Zed").replace("Peter", "Zed").replace("1990", "5").replace("12", "5").replace("30", "5"), False),
    (ITEM.replace("farmer", "baker").replace("home", "back"), False),
    ("Yes", False),
])
def test_slots_answer_one_to_one(spark, text, held):
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, ITEM), (8, "Yes")], "item_id long, text string")
    found = {r["item_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert (7 in found) == held == plain_holds(plain_template(text), plain_template(ITEM))
    assert (8 in found) == (text == "Yes")
    assert decontaminate.uncontaminated(docs, bench).count() == int(not found)


def test_several_blocks_give_the_same_items(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 1 << 10)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == one


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    passage, item, base = sentence(900, 50), sentence(901, 30), sentence(902, 120)
    good = [sentence(i, 60 + i % 7) for i in range(60)] + [sentence(300 + i, 20) + " " + passage + " " + sentence(400 + i, 20) for i in range(3)]
    good += [base, base, base.replace(base.split()[60], "changed", 1), sentence(910, 30) + " " + item, "", None]
    junk = [" ".join(["click here !!! $$$ ###"] * (8 + i % 5)) + f" n{i}" for i in range(30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(good + junk)] + [(None, base, "en", "s", 0), (None, sentence(920, 30) + " " + item, "en", "s", 0)]
    rows += [rows[3], (5, "another text under an id that is in use already", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(junk)) if i != 5], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))

    scored = [(r["doc_id"], r["text"]) for r in quality.with_scores(docs, quality.fit(docs, labels)).collect() if r["score"] >= 0.3]
    assert {d for d, _ in scored}.isdisjoint(range(len(good), len(good) + len(junk))) and len(scored) > 60
    # one document of each group; ids that are null stand behind all others
    named = sorted({((d is None, d or 0, "" if d is not None else t), t) for d, t in scored}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingles(t) for _, t in named]
    linked = [(a, b) for a in range(len(named)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = least_reachable(range(len(named)), linked)
    kept = [named[k] for k in range(len(named)) if label[k] == k]
    words, gone = brute_windows(list(enumerate(t for _, t in kept)), 35)
    cut = [(d, " ".join(w for w, g in zip(words[k], gone[k], strict=True) if not g) if any(gone[k]) else t) for k, (d, t) in enumerate(kept)]
    assert any(map(any, gone.values()))
    held = plain_template(item)
    left = [(d, t) for d, t in cut if not plain_holds(plain_template(t), held)]
    assert len(left) == len(cut) - 2
    fast = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = sorted((0 if d[0] else d[1], len(fast.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*fast.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for d, t in left)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = sorted((r["doc_id"] or 0, r["doc_tokens"], r["ids_crc32"]) for r in packed if r["length"] == r["doc_tokens"])
    assert set(whole) <= set(tokens)
    assert sum(r["length"] for r in packed) == sum(n for _, n, _ in tokens)
    assert sorted({(r["doc_id"] or 0, r["doc_tokens"]) for r in packed}) == sorted({(d, n) for d, n, _ in tokens})
    assert identified(docs).columns == ["doc_id", "h", "text"]
