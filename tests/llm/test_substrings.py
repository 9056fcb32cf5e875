import hashlib
from collections import Counter

import numpy as np
import pytest

from trialspark.llm.substrings import anchors, op4, remove_repeats, repeated_windows


def slow(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)))
    return out


def made(rng, letters, count):
    pool = [bytes(rng.choice(letters, int(rng.integers(30, 300))).tolist()) for _ in range(12)]
    texts = []
    for _ in range(count):
        parts = [pool[int(rng.integers(12))] if rng.random() < 0.5 else bytes(rng.choice(letters, int(rng.integers(0, 150))).tolist()) for _ in range(int(rng.integers(0, 7)))]
        texts.append(b"".join(p[int(rng.integers(0, 9)) :] for p in parts))
    return texts


def test_every_window_has_one_anchor_inside_it():
    rng = np.random.default_rng(0)
    for letters in (b"ab", bytes(range(97, 123))):
        t = bytes(rng.choice(list(letters), 5000).tolist()) + b"xyz" * 300
        h, at, low, high = anchors(t)
        assert low[0] == 0 and high[-1] == len(t) - 199 and (low[1:] == high[:-1]).all()
        assert (at >= high - 1).all() and (at + 24 <= low + 200).all()
    assert len(anchors(b"x" * 199)[0]) == 0


@pytest.mark.parametrize("seed", range(8))
def test_windows_of_a_block(seed):
    rng = np.random.default_rng(seed)
    texts = made(rng, list(b"abc\x00\xff") if seed % 2 else list(b"ab\n"), 9)
    counts = Counter(t[i : i + 37] for t in texts for i in range(len(t) - 36))
    for t, got in zip(texts, repeated_windows(texts, 37), strict=True):
        assert got.tolist() == [i for i in range(len(t) - 36) if counts[t[i : i + 37]] > 1]


@pytest.mark.parametrize("hot", [4096, 3])
def test_random_texts_against_brute_force(spark, hot):
    rng = np.random.default_rng(hot)
    texts = made(rng, list("abcdé \n".encode("latin-1")), 150)
    strings = [t.decode("latin-1") for t in texts]
    df = spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")
    want = slow([s.encode() for s in strings], 64)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df, 64, hot).collect()}
    assert len(got) == 150 and all(got[i] == w for i, w in enumerate(want)) and any(w[1] for w in want)


def test_edge_rows(spark):
    long = "abcdefghij" * 30000
    rows = [(1, None, 5), (2, "", 5), (3, "x" * 199, 5), (4, "x" * 199, 5), (None, "y" * 150 + "1", 5), (7, long, 5), (8, "q" * 200, 5), (8, "q" * 200, 5), (None, "z" * 201, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(df).collect()), key=str)
    want = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 199, 0, 0), (4, 199, 0, 0), (None, 151, 0, 0), (7, 300000, 300000, 1), (8, 200, 200, 1), (8, 200, 200, 1), (None, 201, 201, 1)]
    assert got == sorted(want, key=str)
    assert remove_repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, r, s, hashlib.sha256(k).hexdigest()) for (d, _), (n, r, s, k) in zip(docs, slow([t for _, t in docs], 200), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4(spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())
