"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A token is a run of letters and digits or a run of other visible characters, so that marks stuck to words
are seen. Single tokens and pairs of neighbours (all pairs of equal neighbours are one feature) are hashed to
2**BITS weights, with damped counts and unit length. FTRL-Proximal
runs in up to SHARDS tasks over a bounded sample of labelled rows, where the rarer label weighs more by the root of its rarity;
the shards' weights are averaged. Every
text is then scored by one sparse dot product in a narrow map over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.hashing import Windows, Words, slices
from loomspan.session import small_arrow_batches

BITS = 18
SAMPLE_ROWS = 16_000
SHARDS = 4
SHARD_LEAST = 2000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1

REPEATED_TOKEN = np.uint64(0x5EED5EED00000000)

_CLASSES = np.full(256, 2, dtype=np.uint8)
_CLASSES[:33] = 0
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text; a text without tokens has none."""
    tokens = Words(data, bounds, classes=_CLASSES)
    runs = Windows(tokens.hash)
    pairs = runs.each(2)
    pairs[tokens.hash[1:] == tokens.hash[:-1]] = REPEATED_TOKEN
    shift = np.uint64(64 - BITS)
    single, pairs = (tokens.hash >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
    for a, b in zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist(), strict=True):
        index, count = np.unique(np.concatenate([single[a:b], pairs[a : max(a, b - 1)]]), return_counts=True)
        value = np.sqrt(count)
        yield index, value / np.sqrt(value @ value) if len(value) else value


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[index] @ value + self.bias, -35, 35))))


class Ftrl:
    """FTRL-Proximal over sparse rows; the bias is not regularised."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        w, bias = self._weights(self.z[index], self.n[index]), -self.bias_z * ALPHA / (BETA + self.bias_n**0.5)
        miss = weight * (1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35))) - label)
        g = miss * value
        self.z[index] += g - (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / ALPHA * w
        self.n[index] += g * g
        self.bias_z += miss - ((self.bias_n + miss * miss) ** 0.5 - self.bias_n**0.5) / ALPHA * bias
        self.bias_n += miss * miss

    def model(self) -> Model:
        return Model(self._weights(self.z, self.n), -self.bias_z * ALPHA / (BETA + self.bias_n**0.5))


def _train(group: pa.Table) -> pa.Table:
    group = group.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    labels = group.column("label").to_pylist()
    rows = [x for _, _, data, bounds in slices(group.column("text")) for x in features(data, bounds)]
    share = [max(1, labels.count(k)) * 2 / max(1, len(labels)) for k in (0, 1)]
    ftrl = Ftrl()
    for _ in range(EPOCHS):
        for (index, value), label in zip(rows, labels, strict=True):
            ftrl.learn(index, value, label, share[label] ** -0.5)
    model = ftrl.model()
    return pa.table({"rows": [len(labels)], "weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias]})


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The averaged model of at most SAMPLE_ROWS labelled rows, chosen by the hash of their doc_id; held-out rows are never used.

    Null labels and labels without a document are skipped; of labels that contradict each other the least counts. Without any
    labelled row all weights are 0. Rows that repeat a labelled doc_id are all learned from.
    """
    small_arrow_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    usable = usable.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")).withColumn("place", F.xxhash64("doc_id"))
    sample = usable.orderBy("place", "doc_id").limit(SAMPLE_ROWS)
    shards = max(1, min(SHARDS, sample.count() // SHARD_LEAST))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.withColumn("shard", F.pmod(F.shiftright("place", 7), F.lit(shards)))
    got = texts.groupBy("shard").applyInArrow(_train, "rows long, weights binary, bias double").collect()  # one row for each shard
    total = sum(r["rows"] for r in got)
    if not total:
        return Model(np.zeros(1 << BITS), 0.0)
    weights = sum(np.frombuffer(r["weights"], dtype=np.float32).astype(np.float64) * (r["rows"] / total) for r in got)
    return Model(weights, sum(r["bias"] * r["rows"] for r in got) / total)


def with_scores(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the model's score of each whole text in column `into`. Null and empty texts get the bias alone."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(*x) for _, _, data, bounds in slices(texts) for x in features(data, bounds)], pa.float64())

    return docs.withColumn(into, score(F.col("text").cast("string")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; only doc_id and text are read.

    Rows that repeat a doc_id are scored one by one; a null doc_id is not held out. An empty table gives no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


