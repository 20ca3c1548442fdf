"""Extraction, classifier, filters, packing, shards, decontamination and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from loomspan.llm import queries
from loomspan.llm.decontaminate import contaminated
from loomspan.llm.html_text import main_text
from loomspan.llm.kd_shards import kd_shards
from loomspan.llm.packing import pack
from loomspan.llm.quality import quality
from tests.llm.conftest import sentence

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One &amp; two\n three</p><p>Four</p></article><footer>foot</footer></body></html>"
    assert main_text(page) == "Head\nOne & two three\nFour"
    assert main_text(None) == main_text("") == main_text("<p>") == ""


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(map(tuple, con.sql(queries.OP4_SQL + " ORDER BY 1").fetchall()))
    got = queries.op4_url_filter(spark, SF)
    assert sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()) == want


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality(docs, labels)
    assert scored.count() == docs.count()
    both = scored.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in both)


def test_quality_without_labels_and_with_odd_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    assert quality(no_docs, none).count() == 0


def test_contaminated(spark, docs, no_docs):
    item = "In 1990 the farmer Anna sold 12 kg of apples to Peter for 30 dollars and went home by train"
    other = item.replace("1990", "2011").replace("Anna", "Maria").replace("12", "77").replace("Peter", "John").replace("30", "5")
    mixed = "In 1990 the farmer Anna sold apples. Then some more words came and nothing else was said about it."
    texts = spark.createDataFrame([(1, sentence(9, 50) + ". " + item), (2, "x. " + other + ". " + sentence(8, 40)), (3, mixed), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(texts, bench).collect()) == [(1, 7), (2, 7)]
    assert contaminated(docs, bench).count() == contaminated(no_docs, bench).count() == contaminated(texts, bench.limit(0)).count() == 0


def test_contaminated_equals_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = docs.join(F.broadcast(bench.select("item_id", F.col("text").alias("item"))), F.contains("text", "item")).select("doc_id", "item_id")
    assert {tuple(r) for r in contaminated(docs, bench).select("doc_id", "item_id").collect()} == {tuple(r) for r in plain.collect()}


@pytest.mark.parametrize("ranks", [True, False])
def test_packing_round_trip(docs, rows, no_docs, ranks):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    args = (path, P.path("byte_bpe_50k.tiktoken") if ranks else None, P.PATTERN, 128)
    fast = Tokenizer.from_file(path)
    ids = {i: np.array([*fast.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in rows}
    pieces = pack(docs, *args).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    filled = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 128 and sum(128 - n for n in filled.values()) < 128
    assert pack(no_docs, *args).count() == 0


def test_kd_shards(docs, rows, no_docs):
    got = kd_shards(docs, 4).collect()
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in rows}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["shard"] for r in got} <= set(range(4))
    assert kd_shards(no_docs, 4).count() == 0


def test_kd_shards_are_near_equal(spark):
    load = kd_shards(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in load]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.05


def test_pipeline(spark, tmp_path):
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
    item = sentence(50, 30)
    texts = [sentence(60 + i, 60) for i in range(8)]
    texts += [texts[0], sentence(70, 30) + " " + item, None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert left == set(range(12)) - {8, 9}
