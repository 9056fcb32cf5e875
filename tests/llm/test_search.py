import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare

from trialspark.llm import search as S
from trialspark.llm.common import REGISTRY

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(ASCII) for t in TERM.findall(text or "")]


def slow(docs, queries, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    big, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        scored = []
        for d, c in counts:
            m = 25 + 75 * c.total() * big // total
            score = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_sql(spark, con, sf):
    assert compare(spark, con, REGISTRY["op13_max_sketches"], sf) == ""


@pytest.mark.parametrize("width", [1 << 16, 8])
@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_equals_brute_force_with_collisions_ties_and_blocks(spark, monkeypatch, width, entries):
    """With eight coordinates nearly all terms collide, so bounds are loose; with 40 entries there are many blocks."""
    monkeypatch.setattr(S, "coordinate", lambda term: S.zlib.crc32(term) % width)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Émile", "ÀB", "x-y", "A1_b"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3 w50 w50 same copy") for i in range(120)]  # a hot group of equal scores
    docs += [(None, "w50 same"), (2000, None), (2001, ""), (2002, "..."), (2003, "w3 " * 40000)]
    queries = [(i, " ".join(rng.choice(words, rng.integers(1, 12), p=p / p.sum()))) for i in range(12)]
    queries += [(50, "same copy w50"), (51, "same same w50"), (52, None), (53, ""), (54, "unheard"), (55, "W1 w1 É é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame([(*x, "extra") for x in queries], "item_id long, text string, score string")
    assert found(S.search(S.build_index(d), d, q, block_entries=entries)) == slow(docs, queries)


def test_repeated_rows_and_queries_that_share_an_id(spark):
    docs = [(1, "a b"), (1, "a b"), (1, "a c"), (2, "b c c")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int").repartition(3)
    q = spark.createDataFrame([(7, "a"), (7, "a"), (7, "c")], "item_id long, text string")
    got = found(S.search(S.build_index(d), d, q))
    assert [(r[0], r[1], r[2]) for r in got] == [(7, 1, 1), (7, 1, 2), (7, 2, 1), (7, 2, 1)]


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, queries in [(d.limit(0), q), (d, q.limit(0)), (d, q.limit(0).union(q.selectExpr("item_id", "'z' as text")))]:
        out = S.search(S.build_index(docs), docs, queries)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(1)
    tf, m = rng.integers(1, 10**6, 1000), rng.integers(25, 10**6, 1000)
    assert (S.impact(tf + 1, m) >= S.impact(tf, m)).all()
