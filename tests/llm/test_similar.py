import numpy as np

from trialspark.llm import similar
from trialspark.llm.simhash import fingerprint
from trialspark.llm.similar import between, drop_similar, neighbours


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def text(rng, n=300):
    return " ".join("w%d" % x for x in rng.integers(0, 5000, n))


def edited(rng, t, edits):
    w = t.split()
    for i in rng.integers(0, len(w), edits):
        w[i] = "new%d" % rng.integers(1 << 30)
    return " ".join(w)


def test_near_copies_leave_one_and_clean_documents_stay(spark):
    rng = np.random.default_rng(3)
    rows, groups = [], {}
    for g in range(40):
        base = text(rng)
        for c in range(4):
            rows.append((len(rows), edited(rng, base, c), "s"))
            groups[len(rows) - 1] = g
    for _ in range(150):
        rows.append((len(rows), text(rng, int(rng.integers(5, 300))), "s"))
    got = {r["doc_id"] for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string, print string")).collect()}
    assert set(range(160, 310)) <= got
    left = [sum(1 for d in got if groups.get(d) == g) for g in range(40)]
    assert min(left) == 1 and sum(left) <= 42
    assert sum(4 * g in got for g in range(40)) == 40  # the smallest id of each group


def test_edge_rows(spark):
    rows = [(3, None, 1), (2, "", 1), (None, "a b", 1), (9, "A  b", 1), (9, "A  b", 1), (None, "zz", 1), (4, "q " * 40000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = drop_similar(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:3]) for r in got.collect()), key=str) == sorted([(2, ""), (9, "A  "), (None, "zz"), (4, "q q")], key=str)
    assert drop_similar(df.limit(0)).count() == 0


def sharing(rng, same):
    """Two texts of 450 different 5-word shingles each, of which they share ``same``."""
    words = [f"v{rng.integers(1 << 50)}" for _ in range(1000)]
    return " ".join(words[:454]), " ".join(words[: same + 4] + words[500 : 950 - same])


def test_pairs_at_the_threshold_go_and_pairs_just_below_stay(spark):
    rng = np.random.default_rng(8)
    rows = [(2 * i + k, t) for i in range(400) for k, t in enumerate(sharing(rng, 400 if i < 300 else 399))]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8 > jaccard(rows[600][1], rows[601][1]) > 0.79
    got = {r["doc_id"] for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(2 * i + 1 in got for i in range(300)) <= 3
    assert {2 * i for i in range(300)} | set(range(600, 800)) <= got


def test_one_frequent_line_does_not_make_texts_similar(spark):
    rng = np.random.default_rng(9)
    line = " ".join(f"f{i}" for i in range(12))
    rows = [(i, f" {line} ".join(text(rng, 40) for _ in range(30))) for i in range(40)]
    assert drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40


def test_every_near_pair_of_a_bucket_is_tried():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 256, 256, dtype=np.uint8)
    table = np.where(rng.random((200, 256)) < 0.15, rng.integers(0, 256, (200, 256)), base).astype(np.uint8)
    bucket = np.sort(rng.integers(0, 4, 200))
    root = rng.integers(0, 3, 200)
    got = [tuple(sorted(p)) for i, j in between(table, bucket, root, 186) for p in zip(i.tolist(), j.tolist(), strict=True)]
    near = lambda i, j: bucket[i] == bucket[j] and root[i] != root[j] and (table[i] == table[j]).sum() >= 186
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if near(i, j)}
    assert want and set(got) == want
    i, j = neighbours(table, bucket, 186)
    assert len(i) and ((table[i] == table[j]).sum(axis=1) >= 186).all() and (bucket[i] == bucket[j]).all()


def chains(rng):
    """Texts of which only each and the next one are similar, with others around them."""
    words = [f"c{rng.integers(1 << 50)}" for _ in range(3000)]
    return [" ".join(words[at : at + 600]) for at in range(0, 1200, 50)]


def test_chains_of_pairs_leave_one(spark):
    rng = np.random.default_rng(12)
    rows = list(enumerate(chains(rng) + chains(rng)))
    assert jaccard(rows[0][1], rows[1][1]) > 0.8 > jaccard(rows[0][1], rows[3][1])
    got = {r["doc_id"] for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 24}


def test_fingerprints_and_pivots_alone_find_close_copies(spark, monkeypatch):
    """Without the MinHash candidates, copies within two bits still go; sets that are unlike stay."""
    monkeypatch.setattr(similar, "_by_bucket", lambda members, pairs: spark.createDataFrame([], "a binary, b binary"))
    rng = np.random.default_rng(21)
    rows, want = [], set()
    for _ in range(40):
        base = text(rng, 2000)
        copies = [base, base + " tail", base + " an end"]
        first, *others = (fingerprint(t.encode(), 5) for t in copies)
        want.add(len(rows))
        rows += [(len(rows) + i, t) for i, t in enumerate(copies) if not i or (others[i - 1] ^ first).bit_count() <= 2]
    rows += [(9000, "a b c d e f"), (9001, "a b c d e f " * 3), (9002, None)]
    assert len(rows) > 80
    got = {r["doc_id"] for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {9000, 9001, 9002}


def test_fingerprint_pairs_connect_what_bits_connect(spark):
    rng = np.random.default_rng(22)
    fps = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 30)]
    fps += [f ^ (1 << int(rng.integers(60))) for f in fps[:20]] + [f ^ 0b111 for f in fps[20:]] + fps[:5]
    rows = [(b"%03d" % i, f) for i, f in enumerate(fps)]
    got = {(bytes(r["a"]), bytes(r["b"])) for r in similar.fingerprint_pairs(spark.createDataFrame(rows, "print binary, fp long")).collect()}
    # print 0 to 4 stand for their fingerprints, so the last five are paired with them and the others with one changed bit
    assert got == {(b"%03d" % i, b"%03d" % (30 + i)) for i in range(20)} | {(b"%03d" % i, b"%03d" % (60 + i)) for i in range(5)}
