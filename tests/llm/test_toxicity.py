import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm.toxicity import DRIFT, BUCKETS, Model, buckets_of, decay_rate, drop_toxic, isotonic, log_odds, maximal_segments, op2, score_documents, train


def slow_segments(scores):
    """Take the best segment, then the best on each side of it, as the definition says."""
    best = None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[a:b])
        if s > 1e-12 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and (b - a) < best[1] - best[0])):
            best = (a, b, s)
    if not best:
        return []
    a, b, s = best
    right = [(x + b, y + b, z) for x, y, z in slow_segments(scores[b:])]
    return slow_segments(scores[:a]) + [(a, b, s)] + right


@pytest.mark.parametrize("seed", range(25))
def test_segments_are_those_of_the_definition(seed):
    rng = np.random.default_rng(seed)
    scores = np.where(rng.random(26) < 0.35, rng.random(26) * 3, -1.0)
    hits = [(i, float(s)) for i, s in enumerate(scores) if s > 0]
    got = maximal_segments(hits, 1.0)
    want = slow_segments(scores.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_decay_rate_solves_its_equation():
    s, w = np.array([-0.5, 1.0, 3.0]), np.array([90.0, 7.0, 3.0])
    rate = decay_rate(s, w)
    assert rate > 0 and abs(w @ np.exp(rate * s) / 100 - 1) < 1e-6


def test_log_odds_keep_only_significant_toxic_buckets():
    counts = np.array([[5000, 900, 100], [100, 0, 60], [100, 60, 0], [3, 0, 1]])
    delta = log_odds(counts)
    assert delta[1] > 1 and delta[0] == delta[2] == delta[3] == 0


def test_isotonic_rates_rise():
    got = isotonic(np.array([0, 3, 1, 0, 9.0]), np.array([50, 4, 4, 0, 10.0]))
    assert (np.diff(got) >= 0).all() and got[0] < 0.05 < 0.7 < got[-1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["toxic"], r["predicted"]) for r in got if r["held_out"]]
    found = sum(p for t, p in held if t) / max(1, sum(t for t, _ in held))
    false = sum(p for t, p in held if not t) / sum(1 - t for t, _ in held)
    assert found >= 0.6 and false <= 0.02, (found, false)


def test_edge_texts_and_filter(spark):
    delta = np.zeros(BUCKETS, np.float32)
    delta[buckets_of("scum")] = 5
    model = Model(delta, 4.0, np.linspace(0, 1, 441))
    rows = [(1, None, 1.5), (2, "", 1.5), (3, "fine words", 1.5), (None, "you SCUM, scum", 1.5), (3, "fine words", 1.5), (4, "ok " * 50000 + "scum", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score_documents(df, model).collect()
    assert len(got) == 6 and [len(r["passages"]) for r in got] == [0, 0, 0, 1, 0, 1]
    assert [(p["a"], p["b"]) for p in got[3]["passages"]] == [(1, 3)]
    left = drop_toxic(df, model, 0.05)
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[4]], key=str)
    assert score_documents(df.limit(0), model).count() == 0


def test_training_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for d in (docs, docs.limit(0)):
        model = train(d, labels, F.lit(True))
        assert score_documents(d, model).filter("score > 0.3").count() == 0
    assert DRIFT > 0


def test_scores_against_a_slow_scorer(spark):
    """Scores of all documents by plain loops over every segment, with the trained model's own numbers."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    got = {r["doc_id"]: (r["score"], len(r["passages"])) for r in score_documents(docs, model).collect()}
    flagged = 0
    for r in docs.collect():
        words = re.findall(r"\w+", (r["text"] or "").lower())
        scores = [max(float(model.delta[b]) for b in buckets_of(w)) for w in words]
        best, low, total = 0.0, 0.0, 0.0
        for s in scores:  # the best segment's score is the largest rise of the running total
            total += s if s > 0 else -DRIFT
            best = max(best, total - low)
            low = min(low, total)
        x = model.rate * best - math.log(len(words)) if best > 0 else -20.0
        i = min(len(model.steps) - 1, max(0, int((x + 20.0) / 0.5)))
        near = abs((x + 20.0) / 0.5 - round((x + 20.0) / 0.5)) < 1e-6  # rounding may put it in either bin
        assert near or abs(got[r["doc_id"]][0] - model.steps[i]) < 1e-12, r["doc_id"]
        flagged += got[r["doc_id"]][1] > 0
    assert flagged > 0
