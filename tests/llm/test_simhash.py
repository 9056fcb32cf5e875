import re
from collections import defaultdict

import numpy as np
import xxhash

from trialspark.llm.components import connected_components
from trialspark.llm.simhash import fingerprint, linked, near_duplicates, op5


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: list of (doc_id, fingerprint); smallest reachable id of each."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least[root(i)], d)
    return [least[root(i)] for i in range(len(prints))]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(want, slow_components(want), strict=True))
    assert sorted(map(tuple, op5(spark, sf).collect())) == want


def test_fingerprints_of_odd_texts():
    for t in ["", "  \n", "One", "one TWO", "É é\x1cx\x85y z", "a b c d " * 3000, None]:
        assert fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_links_of_random_close_values_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(60)]
    values = np.unique(np.array(values, np.uint64))
    root = linked(values, np.zeros(len(values), np.int64), 2)
    want = slow_components(list(enumerate(map(int, values))))
    pairs = {(i, j) for i in range(len(values)) for j in range(i)}
    assert all((root[i] == root[j]) == (want[i] == want[j]) for i, j in pairs)


def test_chains_copies_nulls_and_extra_columns(spark):
    rows = [(5, None, 1), (2, "", 1), (9, "A b  c", 1), (9, "a B c", 1), (None, "a b c", 1), (None, "z z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == {(5, 2), (2, 2), (9, 9), (None, 9), (None, None)} and near_duplicates(df).count() == 6
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_large_star(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    star = spark.range(2000).selectExpr("1000L as a", "2000 + id as b")
    got = {r["node"]: r["root"] for r in connected_components(path.union(star)).collect()}
    assert len(got) == 301 + 2001 and all(got[i] == 0 for i in range(301)) and all(got[2000 + i] == 1000 for i in range(2000))
