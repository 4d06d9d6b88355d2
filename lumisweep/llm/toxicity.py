"""Toxicity (operator 6): FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct lower-cased words, their pairs, triples and skip-grams (two
with one left out between), and the same of their stems, hashed into ``2**BITS`` places.  A
stem is the first ``STEM`` bytes of a word, so that inflected forms of a word count together.
Training is FTRL-proximal: every place has a learning rate of its own from the squares of
its past gradients, and the L1 term leaves places without evidence at zero, so the model
that is sent to the tasks is a short list of places and weights.

A bounded sample is learned: at most about ``SAMPLE_ROWS`` rows of each label, chosen by a
hash of ``doc_id``, dealt into shards of about ``SHARD_ROWS`` rows by a hash of the text.  Each
shard is learned in its own task, ``EPOCHS`` times in a fixed order, and the weights of the
shards are averaged.  A class weight makes up for the rarer label; the intercept is learned
with the others.

A text without words has no features and gets the intercept's score.  Rows with a null
label or text, or a label other than 0 and 1, teach nothing; a document with several
labels is learned once with each.  Repeated rows teach once and are scored each.  Without
training rows every score is 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, record_batch, settle
from lumisweep.llm.langid import held_out
from lumisweep.llm.words import fold, mix, text_blocks

BITS = 20
SAMPLE_ROWS = 20_000
SHARD_ROWS, EPOCHS = 5_000, 4
#: At most this weight for the rows of the rarer label.
RARE = 6.0
STEM = 4
#: Word offsets of the stem features: single, pair, triple, skip-gram.
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2))
ALPHA, BETA, L1_PER_ROW, L2 = 1.0, 1.0, 0.0025, 0.1
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def features(words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Distinct places of one text's words and stems, and of n-grams and skip-grams of both."""
    found = [words]
    for base, units in ((0, stems), (1 << 10, words)):
        for offsets in GRAMS:
            count = len(units) - offsets[-1]
            # Single words are places by themselves already.
            if count > 0 and (units is stems or len(offsets) > 1):
                kind = np.full(count, base + sum(4 ** i for i in offsets), np.uint64)
                found.append(mix(fold([kind, *(units[i:i + count] for i in offsets)])))
    return np.unique(np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


def texts_features(texts: pa.Array) -> Iterator[np.ndarray]:
    for block in text_blocks(texts, lower=True):
        stems = block.stems(STEM)
        for j in range(len(block.rows)):
            part = slice(block.offsets[j], block.offsets[j + 1])
            yield features(block.hashes[part], stems[part])


class Ftrl:
    """FTRL-proximal with the last place as intercept, which has no L1 term."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = 1.0, l2: float = L2):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.l1 = np.full((1 << BITS) + 1, l1)
        self.l1[-1] = 0

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z = self.z[places]
        push = np.maximum(np.abs(z) - self.l1[places], 0)
        return -np.sign(z) * push / ((self.beta + np.sqrt(self.n[places])) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, label: int, weight: float) -> None:
        places = np.append(places, len(self.z) - 1)
        w = self.weights(places)
        slope = weight * (_logistic(w.sum()) - label)
        before = self.n[places]
        after = before + slope * slope
        self.z[places] += slope - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[places] = after


def _logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Distinct ``doc_id, label``, about ``sample_rows`` of each label, by a hash of the id."""
    usable = labels.where("doc_id is not null and label in (0, 1)").select(
        "doc_id", "label").distinct()
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, sample_rows / n)).otherwise(share)
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a model of ``doc_id, text`` and ``doc_id, label``.

    Both are empty without any labelled rows.  The sampled ids are distinct and broadcast,
    about ``2 * sample_rows`` of them at most, so that only sampled texts are shuffled; of an
    id with several rows one text teaches, the one of the smallest hash.
    """
    picked = sample(labels, sample_rows)
    hashed = F.struct(F.xxhash64("text").alias("_hash"), "text")
    drawn = settle(docs.where("text is not null").join(F.broadcast(picked), "doc_id")
                   .groupBy("doc_id", "label").agg(F.min(hashed).alias("_one"))
                   .select("label", "_one._hash", "_one.text"))
    taken = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    if not taken:
        return np.zeros(0, np.int64), np.zeros(0)
    scale = {k: sum(taken.values()) / (2 * n) for k, n in taken.items()}
    shards = math.ceil(sum(taken.values()) / shard_rows)
    chosen = drawn.withColumn("_shard", F.pmod(
        F.shiftrightunsigned("_hash", 24), F.lit(shards)).cast("int"))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[int, list[tuple[np.ndarray, int]]] = {}
        for frame in frames:
            found = texts_features(pa.array(frame["text"], pa.string()))
            for shard, label, places in zip(frame["_shard"], frame["label"], found):
                models.setdefault(shard, []).append((places, int(label)))
        for _, examples in sorted(models.items()):
            model = Ftrl(l1=L1_PER_ROW * len(examples))
            for _ in range(EPOCHS):
                for places, label in examples:
                    model.learn(places, label, min(scale[label], RARE))
            found = np.flatnonzero(model.weights(slice(None)))
            yield pd.DataFrame({"place": found, "w": model.weights(found),
                                "rows": len(examples)})

    learned = (chosen.select("_shard", "_hash", "label", "text")
               .repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_hash", "label")
               .mapInPandas(learn, "place long, w double, rows long"))
    # At most 2**BITS + 1 rows, most of them zero and not there.
    total = sum(taken.values())
    mean = (learned.groupBy("place").agg(F.sum(F.col("w") * F.col("rows")).alias("w"))
            .toPandas().sort_values("place"))
    return mean["place"].to_numpy(), mean["w"].to_numpy() / total


def score(docs: DataFrame, places: np.ndarray, weights: np.ndarray,
          folds: int = 5, fold_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id").cast("long"), folds, fold_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast((places, weights))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SCORED)
        where, value = model.value
        dense = np.zeros((1 << BITS) + 1)
        dense[where] = value
        for batch in batches:
            sums = np.array([dense[f].sum() for f in texts_features(batch.column(2))])
            chance = _logistic(sums + dense[-1]) if len(where) else np.zeros(len(sums))
            yield record_batch([batch.column(0), batch.column(1), chance,
                                (chance >= 0.5).astype(np.int32)], schema)

    return rows.mapInArrow(judge, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents outside the held-out fold and score every document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    return score(docs, *train(texts, known.where(~held_out(F.col("doc_id"), 5, 0))))
