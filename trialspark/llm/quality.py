"""Text quality by hashed word n-grams and logistic regression trained with FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import crc_bucket, documents, query, text_of
from trialspark.llm.toxicity import sample_labels

BITS = 18
SAMPLE = 4_000  # labelled rows per class at most; they are learnt in one task
EPOCHS = 4
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 1 << 19
_MIX = np.uint32(0x9E3779B1)
AGAIN = np.uint32(0x5BD1E995)


class _Hashes(dict):
    """Token to 32-bit hash, filled as tokens appear."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        found = self[token] = zlib.crc32(token.encode())
        return found


def features(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values (norm 1) of a text's words, punctuation runs and pairs of neighbours.

    A pair of equal neighbours is one bucket whatever the word, and so is a triple with equal ends
    (a repeated word and its punctuation), so that repetition is a feature of its own. A text without tokens has no features.
    """
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint32, len(tokens))
    two = (one[:-1] * _MIX) ^ (one[1:] + np.uint32(0x85EBCA6B))
    two[one[:-1] == one[1:]] = AGAIN
    near = np.full(np.count_nonzero(one[:-2] == one[2:]), AGAIN + np.uint32(1))
    mixed = np.concatenate([one, two, near])
    mixed = (mixed ^ (mixed >> np.uint32(15))) * _MIX
    counts = np.bincount(mixed >> np.uint32(32 - BITS)) if len(mixed) > 1 << 15 else None
    if counts is None:
        buckets, n = np.unique(mixed >> np.uint32(32 - BITS), return_counts=True)
    else:
        buckets = np.flatnonzero(counts)
        n = counts[buckets]
    values = n.astype(np.float32)
    return buckets.astype(np.int64), values / np.float32(np.sqrt(values @ values))


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates (McMahan et al., 2013)."""

    def __init__(self, size: int = 1 << BITS):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _with_bias(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, 1 << BITS), np.append(x, 1.0)


def train(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", per_class: int = SAMPLE) -> np.ndarray:
    """Weights per bucket, the bias last, learnt from labelled rows for which ``allowed`` holds.

    At most ``per_class`` rows of each class are used, chosen and put in order by a hash of their id,
    so the fit is one bounded task with a repeatable result. NULL ids and labels are not used; without
    any row all weights are 0 and every score is one half.
    """
    sample = sample_labels(labels, label, allowed, per_class)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("text", "y", F.xxhash64("doc_id", "text").alias("at"), F.lit(0).alias("one"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, model = _Hashes(), Ftrl()
        pdf = pdf.sort_values("at", kind="stable")
        examples = [(*_with_bias(*features(t, hashes)), float(y)) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
        for _ in range(EPOCHS):
            for at, x, y in examples:
                model.learn(at, x, y)
        w = model.weights(np.arange(len(model.z)))
        used = np.flatnonzero(w)
        return pd.DataFrame({"bucket": used, "weight": w[used]})

    got = rows.groupBy("one").applyInPandas(fit, "bucket long, weight double").toPandas()  # 2**BITS + 1 rows at most
    weights = np.zeros((1 << BITS) + 1)
    weights[got["bucket"].to_numpy(np.int64)] = got["weight"].to_numpy(float)
    return weights


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Add ``score``, the probability of good quality, to ``docs`` (a column of that name is replaced).

    NULL, empty and tokenless texts score by the bias alone. Whole texts are read, row by row.
    """
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*kept, text_of().alias("__text"))
    schema = rows.drop("__text").withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = shared.value, _Hashes()
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(len(kept))):
                at, x = features(text.as_py(), hashes)
                margins[i] = w[at] @ x + w[-1]
            score = 1 / (1 + np.exp(-np.clip(margins, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score)], names=[*kept, "score"])

    return rows.mapInArrow(run, schema)


@query("op7_ftrl_ngrams")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc_bucket("doc_id", 5) != 0)
    scored = score_documents(docs, weights)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
