import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trialspark.llm.quality import BITS, Ftrl, _Hashes, _with_bias, features, op7, score_documents, train


def test_features_have_norm_one_and_see_repetition():
    h = _Hashes()
    at, x = features("The cat, the cat!!", h)
    assert abs(x @ x - 1) < 1e-6 and len(set(at)) == len(at) and at.max() < 1 << BITS
    a, b = (set(features(t, h)[0]) for t in ("one one", "two two"))
    assert len(a & b) == 1
    assert len(features("", h)[0]) == len(features(None or " \n", h)[0]) == 0
    long = features("word other " * 50000, h)
    assert len(long[0]) == 5


def test_ftrl_learns_a_separable_rule():
    rng, model = np.random.default_rng(0), Ftrl()
    for _ in range(400):
        y = float(rng.random() < 0.5)
        model.learn(*_with_bias(np.array([1 if y else 2, 5]), np.array([0.7, 0.7])), y)
    w = model.weights(np.array([1, 2]))
    assert w[0] > 0.5 and w[1] < -0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op7(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["quality"], r["predicted"]) for r in got if r["held_out"]]
    bad, good = [p for q, p in held if not q], [p for q, p in held if q]
    assert 1 - np.mean(bad) >= 0.8 and np.mean(good) >= 0.98, (1 - np.mean(bad), np.mean(good))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "fine text", "a"), (3, "x " * 40000, "a"), (3, "x " * 40000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    w = np.zeros((1 << BITS) + 1)
    w[-1] = 2
    got = score_documents(df, w).collect()
    assert len(got) == 5 and {round(r["score"], 4) for r in got} == {0.8808}
    assert score_documents(df.limit(0), w).count() == 0
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    assert len(train(df, labels, F.lit(True))) == (1 << BITS) + 1
    assert not train(df.limit(0), labels, F.lit(True)).any()


def slow_features(text):
    """Bucket to value with plain integers."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    one, full = [zlib.crc32(t.encode()) for t in tokens], 2**32
    seen = list(one)
    seen += [0x5BD1E995 if a == b else (a * 0x9E3779B1 % full) ^ ((b + 0x85EBCA6B) % full) for a, b in zip(one, one[1:])]
    seen += [0x5BD1E995 + 1 for a, b in zip(one, one[2:]) if a == b]
    counts = Counter((x ^ (x >> 15)) * 0x9E3779B1 % full >> (32 - BITS) for x in seen)
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {b: n / norm for b, n in counts.items()}


def slow_scores(examples, texts):
    """FTRL-proximal with a dictionary entry per coordinate, then a logistic score of every text."""
    z, n = {}, {}

    def weight(b):
        zb = z.get(b, 0.0)
        return 0.0 if abs(zb) <= 1e-4 else (math.copysign(1e-4, zb) - zb) / ((1.0 + math.sqrt(n[b])) / 1.0 + 1e-4)

    def margin(x):
        return sum(weight(b) * v for b, v in x.items())

    ready = [({**slow_features(t), "bias": 1.0}, y) for t, y in examples]
    for _ in range(4):
        for x, y in ready:
            g = 1 / (1 + math.exp(-margin(x))) - y
            step = {b: (weight(b), g * v) for b, v in x.items()}
            for b, (w, gb) in step.items():
                old = n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + gb - (math.sqrt(old + gb * gb) - math.sqrt(old)) * w
                n[b] = old + gb * gb
    return [1 / (1 + math.exp(-margin({**slow_features(t), "bias": 1.0}))) for t in texts]


def test_query_against_a_slow_trainer(spark, sf):
    """Every score of the query by a trainer and scorer in plain Python, on the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    order = docs.withColumn("at", F.xxhash64("doc_id", "text")).orderBy("at").collect()
    learnt = [(r["text"] or "", labels[r["doc_id"]]) for r in order if labels.get(r["doc_id"]) in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = dict(zip([r["doc_id"] for r in order], slow_scores(learnt, [r["text"] or "" for r in order])))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in op7(spark, sf).collect()}
    assert got.keys() == want.keys() and len(learnt) > 20
    assert max(abs(got[d][0] - want[d]) for d in want) < 1e-4
    assert all(got[d][1] == (want[d] >= 0.3) for d in want if abs(want[d] - 0.3) > 1e-3)
