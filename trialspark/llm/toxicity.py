"""Toxicity by maximum-scoring segments of token log-odds.

Word forms are counted over all documents (the Dirichlet prior) and in a bounded sample of labelled
ones; significant log-odds become token scores, all other tokens cost a small drift. One linear scan
finds every maximal scoring segment of a text (Ruzzo and Tompa), whose score is judged by the
extreme-value law of random scores (Karlin and Altschul) and calibrated against the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import crc_bucket, documents, lean, query, text_of

BUCKETS = 1 << 18  # hashed word forms; bounds the model, its broadcast and what reaches the driver
PREFIXES = (4, 6)
SAMPLE = 20_000  # labelled rows per class at most
SIGNIFICANT = 4.0  # standard errors of a token's log-odds
DRIFT = 0.05  # cost of a token without significant log-odds
LEVEL = 0.01  # expected number of chance segments below which a passage counts as toxic
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
CACHE = 1 << 17  # words that a task remembers
BIN, LOW, HIGH = 0.5, -20.0, 200.0  # calibration bins


def buckets_of(word: str) -> list[int]:
    """Buckets of the word and of its first letters (stems are inflected)."""
    forms = {word, *(f"{word[:k]}\0{k}" for k in PREFIXES if len(word) >= k)}
    return [xxhash.xxh64_intdigest(f) & (BUCKETS - 1) for f in forms]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sample_labels(labels: DataFrame, label: str, allowed, per_class: int) -> DataFrame:
    """``doc_id, y`` for at most ``per_class`` rows of each class, chosen by a hash of the id."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(allowed)
    parts = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def form_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Per bucket: distinct words per document over all rows, in clean and in toxic sample rows.

    The sample has a fixed bound, so its broadcast has too. A task emits each bucket at most once
    per flush.
    """
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("y", F.lit(-1)).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {-1: Counter(), 0: Counter(), 1: Counter()}
        totals = np.zeros((BUCKETS, 3), np.int64)

        def flush() -> None:
            for y, counter in counts.items():
                for word, n in counter.items():
                    for b in buckets_of(word):
                        totals[b, 0] += n
                        if y >= 0:
                            totals[b, 1 + y] += n
                counter.clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y].update(set(words_of(text.as_py())))
                if sum(map(len, counts.values())) > CACHE:
                    flush()
        flush()
        used = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(totals[used, i]) for i in range(3))], names=["bucket", "n_all", "n_clean", "n_toxic"])

    found = rows.mapInArrow(lean(run), "bucket long, n_all long, n_clean long, n_toxic long")
    return found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_clean", "n_toxic")])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Significant log-odds per bucket, else 0. ``counts``: rows of (all, clean, toxic).

    The prior spreads as many pseudo-counts as the toxic sample has over the buckets, in proportion
    to their counts in the whole corpus (Monroe et al., 2008).
    """
    everything, clean, toxic = counts.T.astype(float)
    n_clean, n_toxic = clean.sum(), toxic.sum()
    if not n_clean or not n_toxic:
        return np.zeros(len(counts))
    prior = np.maximum(everything / max(everything.sum(), 1) * n_toxic, 1e-9)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(2 * n_toxic - a, 1e-9)) - np.log(b / np.maximum(n_toxic + n_clean - b, 1e-9))
    z = delta / np.sqrt(1 / a + 1 / b)
    return np.where(z >= SIGNIFICANT, delta, 0.0)


def decay_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of Σ p·exp(λ·s) = 1: how fast chance segment scores die out."""
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(x * scores, 700.0))) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment as (from, to, score), tokens outside ``hits`` scoring −drift.

    ``hits`` holds (position, positive score) in order. Linear time: a candidate joins the nearest
    earlier one that starts lower, and each candidate is dropped or kept once.
    """
    stack: list[tuple[int, int, float, float]] = []  # from, to, cumulative score before and after
    below: list[int] = []  # index of the nearest earlier candidate with a smaller score before it
    total, at = 0.0, 0
    for position, score in hits:
        total -= drift * (position - at)
        start, before, total, at = position, total, total + score, position + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = below[j]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, position + 1, before, total))
                below.append(j)
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


@dataclass(frozen=True)
class Model:
    delta: np.ndarray  # per bucket
    rate: float
    steps: np.ndarray  # calibrated probability per bin

    def calibrated(self, x: float) -> float:
        i = min(len(self.steps) - 1, max(0, int((x - LOW) / BIN)))
        return float(self.steps[i])


class _Scores(dict):
    """Word to token score, filled as words appear; 0 for words without significant log-odds."""

    def __init__(self, delta: np.ndarray):
        self.delta = delta

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = float(max(self.delta[buckets_of(word)]))
        return found


def _segments(words: list[str], scores: _Scores) -> list[tuple[int, int, float]]:
    return maximal_segments([(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s > 0])


def _evidence(segments: list[tuple[int, int, float]], n: int, rate: float) -> float:
    """λ·S − ln n of the best segment; the lowest bin for a text without any."""
    return max((rate * s for _, _, s in segments), default=LOW) - (math.log(n) if n and segments else 0.0)


def train(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", per_class: int = SAMPLE) -> Model:
    """Fit on labelled rows for which the condition ``allowed`` on ``doc_id`` holds.

    Word counts for the prior come from every document. Rows without label, with NULL id or label, and
    documents that aren't in ``docs`` are not used; without rows of both classes no token scores.
    """
    sample = sample_labels(labels, label, allowed, per_class)
    counts = np.zeros((BUCKETS, 3), np.int64)
    rows = form_counts(docs, sample).toPandas()  # BUCKETS rows at most
    counts[rows["bucket"].to_numpy()] = rows[["n_all", "n_clean", "n_toxic"]].to_numpy()
    delta = log_odds(counts)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(delta.astype(np.float32))
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            found: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if y == 0:
                    found.update(round(s, 2) for s in map(scores.__getitem__, words_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], names=["s", "n"])

    seen = chosen.mapInArrow(lean(spread), "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()  # scores have two decimals
    values, weights = seen["s"].to_numpy(float), seen["n"].to_numpy(float)
    positive = delta[delta > 0]
    values = np.where(values > 0, values, -DRIFT)
    values = np.append(values, [-DRIFT, float(np.median(positive)) if len(positive) else 1.0])  # one chance hit at least
    rate = decay_rate(values, np.append(weights, [2.0, 1.0]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            xs = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                x = _evidence(_segments(words, scores), len(words), rate)
                xs.append(int((min(max(x, LOW), HIGH) - LOW) / BIN))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int32()), batch.column(1).cast(pa.int64())], names=["bin", "y"])

    table = chosen.mapInArrow(lean(bins), "bin int, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas()
    n, y = np.zeros(int((HIGH - LOW) / BIN) + 1), np.zeros(int((HIGH - LOW) / BIN) + 1)
    n[table["bin"]], y[table["bin"]] = table["n"], table["y"]
    return Model(delta.astype(np.float32), rate, isotonic(y, n))


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing rates y/n by pooling neighbours, with one pseudo-row at the overall rate.

    Bins without rows are filled between their neighbours, so that the steps have no gap.
    """
    base = y.sum() / n.sum() if n.sum() else 0.0
    used = np.flatnonzero(n)
    pools: list[list[float]] = []
    for i in used:
        pools.append([y[i], n[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    rates = [r for yy, nn, k in pools for r in [(yy + base) / (nn + 1)] * int(k)]
    if not len(used):
        return np.full(len(n), base)
    return np.maximum.accumulate(np.interp(np.arange(len(n)), used, rates))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``passages`` to ``docs``, whose columns of these names are replaced.

    ``passages``: each significant segment as word positions [a, b), its score and the number of such
    segments expected by chance. NULL, empty and wordless texts have no passage and the score of
    texts without evidence. The scan is linear in the text.
    """
    kept = [c for c in docs.columns if c not in ("score", "passages")]
    rows = docs.select(*kept, text_of().alias("__text"))
    empty = F.array().cast("array<struct<a:int,b:int,score:double,expected:double>>")
    schema = rows.drop("__text").withColumns({"score": F.lit(0.0), "passages": empty}).schema
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scores = _Scores(fitted.delta)
        for batch in batches:
            out, passages = [], []
            for text in batch.column(len(kept)):
                words = words_of(text.as_py())
                found = _segments(words, scores)
                out.append(fitted.calibrated(_evidence(found, len(words), fitted.rate)))
                chance = [(a, b, s, len(words) * math.exp(-min(fitted.rate * s, 700.0))) for a, b, s in found]
                passages.append([{"a": a, "b": b, "score": s, "expected": e} for a, b, s, e in chance if e < LEVEL])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.float64()), pa.array(passages, kind)], names=[*kept, "score", "passages"])

    return rows.mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without documents that score ``threshold`` or more; columns and other rows as they are."""
    aside = {c: f"__own_{c}" for c in ("score", "passages") if c in docs.columns}
    scored = score_documents(docs.withColumnsRenamed(aside), model).filter(F.col("score") < threshold).drop("score", "passages")
    return scored.withColumnsRenamed({v: k for k, v in aside.items()})


@query("op2_maximal_segments")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc_bucket("doc_id", 4) != 2)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
