"""Supervised subword embeddings for document quality.

Hashed words, word pairs and character 3- and 4-grams have learned vectors; a document is the mean of its vectors, and a
softmax layer gives the probability of each label.
Training is stochastic gradient descent in numpy on the driver, over a bounded sample of labelled documents
(``TRAIN_DOCUMENTS``, none over ``TRAIN_BYTES``), and the model has a fixed size. For scoring, vectors and output layer fold
into one number per bucket, so a document costs one table look-up per n-gram.

Defined cases: a null or empty text has no n-grams and the score of the output bias; repeated rows are scored alike; a document
with several labels counts as the lowest; with no labelled rows every score is 0.5; an empty table gives no row; other
columns are ignored. A text of more than ``PART`` characters is the mean over the n-grams of all its parts, each of which ends after
a space or line break if it has one, so no text is held as n-grams as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, fold, small_batches
from cellweave.llm.textscan import PART, blocks, code_points, gram_hashes, mix, parts, run_hashes, runs

BUCKETS = 1 << 18
DIMENSIONS = 8
TRAIN_DOCUMENTS = 3000
TRAIN_BYTES = 1 << 16
THRESHOLD = 0.3

_SALT_PAIR = np.uint32(0x51ED27)


def bucket_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch, and the text that each belongs to (in no particular order)."""
    parts, edges, at = [np.full(4, 32, np.uint32)], [], 4
    for t in texts:
        c = code_points(t) if t else np.empty(0, np.uint32)
        edges.append(at)
        parts += [c, np.full(4, 32, np.uint32)]
        at += len(c) + 4
    codes = np.concatenate(parts)
    codes = np.where(codes <= 32, np.uint32(32), codes)
    limits = np.append(edges, len(codes))
    starts, ends = runs(codes > 32)
    word = run_hashes(codes, starts, ends)
    owner = np.searchsorted(limits, starts, side="right") - 1
    pair_from = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix(word[pair_from] ^ _SALT_PAIR, word[pair_from + 1])
    ids, owners = [word, pair], [owner, owner[pair_from]]
    inside = np.repeat(np.arange(len(texts)), np.diff(limits)) if texts else np.empty(0, np.int64)
    for n in (3, 4):
        h = gram_hashes(codes, n, n)
        ok = np.flatnonzero(codes[1 : 1 + len(h)] != 32) if n > 1 else None  # those whose second character is no space
        ok = ok[ok >= limits[0] - 1] if len(limits) else ok
        ids.append(h[ok])
        owners.append(inside[ok + 1 - limits[0]])
    return np.concatenate(ids) & np.uint32(BUCKETS - 1), np.concatenate(owners)


@dataclass
class Model:
    weight: np.ndarray  # (BUCKETS,) the log-odds that a bucket adds, times its share of the document
    bias: float

    def score(self, texts: list[str | None], part: int = PART) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, some in parts(texts, part):
            ids, which = bucket_ids(some)
            total += np.bincount(owner[which], self.weight[ids], len(texts))
            count += np.bincount(owner[which], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def fit(rows: list[tuple[str, int]], epochs: int = 5, rate: float = 1.0, seed: int = 11) -> Model:
    """Train on (text, label) rows; labels are 0 and 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    docs = []
    for i in range(0, len(rows), 256):
        ids, owners = bucket_ids([t for t, _ in rows[i : i + 256]])
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order], np.arange(len(rows[i : i + 256]) + 1))
        for a, b, (_, label) in zip(cuts[:-1], cuts[1:], rows[i : i + 256]):
            unique, n = np.unique(ids[order[a:b]], return_counts=True)
            docs.append((unique, (n / max(b - a, 1)).astype(np.float32), label))
    steps = epochs * len(docs)
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, label = docs[k]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            if len(ids):
                # Each n-gram moves by its share, scaled so that a document moves its mean as far as the step says.
                scale = 1 / max(float(share @ share), 1e-3)
                vectors[ids] -= min(step * scale, 50.0) * np.outer(share, back)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCUMENTS) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts, at hashed ids. The ids are few, so their join with the texts is a broadcast."""
    labelled = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    labelled = labelled.agg(F.min("quality").alias("quality"))
    n = labelled.count()
    scale = 1_000_000_000
    most = int(min(1.0, 1.1 * bound / max(n, 1)) * scale)
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < most)
    rows = (
        docs.filter(F.octet_length("text") <= TRAIN_BYTES)
        .select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy(F.xxhash64("doc_id").alias("h"))  # a document counts once, however often its id comes
        .agg(F.min(F.struct("text", "quality")).alias("r"))
        .select("h", "r.text", "r.quality")
        .collect()
    )
    return [(r["text"], r["quality"]) for r in sorted(rows, key=lambda r: r["h"])[:bound]]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for some in blocks(batch.column(1)) for s in shared.value.score(some.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out fold; only texts and labels are seen."""
    return fit(training_rows(docs, labels.filter(fold("doc_id", 5) != 0)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
