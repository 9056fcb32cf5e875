import hashlib
import re

import numpy as np
import pytest
from compare import duck

from trialspark.llm import lines as L
from trialspark.llm.lines import ORACLE, coarse_chunks, op9, remove_repeated_lines

UNIT = re.compile(L.UNIT)


def units(text):
    return UNIT.findall(text or "")


def bare(unit):
    return unit.strip(" \t\r\n")


def chunks(text):
    """Coarse chunks as (first unit, units)."""
    found = units(text)
    h = [int(hashlib.md5(bare(u).encode()).hexdigest()[:8], 16) for u in found]
    candidate = [(h[i] + 31 * (h[i - 1] if i else 0)) % 3 == 0 for i in range(len(found))]
    out, at = [], 0
    for i in range(len(found)):
        if i == len(found) - 1 or (candidate[i] and not (i and candidate[i - 1])):
            out.append((at, found[at : i + 1]))
            at = i + 1
    return out


def slow(docs):
    """Texts without units of repeated coarse chunks and of repeated pairs, but for the first of each."""
    seen_chunks, seen_pairs, gone = {}, {}, {}
    for d, t in sorted(docs):
        for at, c in chunks(t):
            key = tuple(map(bare, c))
            if len(c) > 1 and seen_chunks.setdefault(key, (d, at)) != (d, at):
                gone.setdefault(d, set()).update(range(at, at + len(c)))
        flat = [bare(u) for u in units(t)]
        for i, pair in enumerate(zip(flat, flat[1:])):
            if all(pair) and sum(map(len, pair)) >= 24 and seen_pairs.setdefault(pair, (d, i)) != (d, i):
                gone.setdefault(d, set()).update((i, i + 1))
    return [(d, "".join(u for i, u in enumerate(units(t)) if i not in gone.get(d, ()))) for d, t in sorted(docs)]


def test_query_equals_sql_and_brute_force(spark, sf):
    cols = "doc_id n_lines n_chunks n_removed_lines n_removed_chunks kept_sha256".split()
    got = sorted(tuple(r[c] for c in cols) for r in op9(spark, sf).collect())
    cur = duck(sf).execute(ORACLE)
    assert [x[0] for x in cur.description] == cols
    assert got == sorted(cur.fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert [(r[0], r[5]) for r in got] == [(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in slow(docs)]
    assert [(r[1], r[2]) for r in got] == [(len(units(t)), len(chunks(t))) for _, t in sorted(docs)]
    assert any(r[3] for r in got) and any(r[4] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_random_lines_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "b.", "cc", "", "é", "a long line of letters", "another long line here. With a tail", "Is it? Yes! "]
    docs = [(i, "\n".join(rng.choice(words, int(rng.integers(1, 30))))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((r["doc_id"], r["text"]) for r in remove_repeated_lines(df).collect()) == slow(docs)


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n\nb", " x. y.  z", "one. Two! Three?\nfour", "...\n\n", "é. ñ.\r\nz", "1.5 is. no end"])
def test_units_join_to_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(L.units_of(L.F.col("t")).alias("u")).first()["u"]
    assert got == units(text) and "".join(got) == text


def test_the_cut_gives_the_units_of_the_sql(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab.!? \n\r\té\u2028𝄞"), int(rng.integers(0, 40)))) for _ in range(2000)] + ["." * 300000, ". " * 50000 + "?", "x" * 300000 + "\n\n", " " * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.units_of(L.F.col("t")).alias("u")).collect()
    assert all(r["u"] == units(texts[r["i"]]) for r in rows) and len(rows) == len(texts)


def test_chunks_and_pairs_are_taken_in_generated_code(spark):
    """The text is cut once, and rows leave the arrays inside a generated stage instead of function by function."""
    found = coarse_chunks(spark.createDataFrame([(1, "a line\nanother")], "doc_id long, text string"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, L._pairs(found.withColumn("gone", L.F.lit(False))))]
    assert [len(re.findall(r"\*\(\d+\) Generate", p)) for p in plans] == [1, 2]
    assert [p.count("regexp_extract_all") for p in plans] == [1, 1]


def test_chunks_follow_a_shift_and_hold_two_units_inside(spark):
    body = "\n".join(f"line {i}" for i in range(60))
    df = spark.createDataFrame([(1, body), (2, "extra\nmore\n" + body)], "doc_id long, text string")
    rows = coarse_chunks(df).orderBy("doc_id", "a").collect()
    one, two = ([tuple(r["chunk"]) for r in rows if r["doc_id"] == d] for d in (1, 2))
    assert sum(map(len, one)) == 60 and sum(map(len, two)) == 62
    assert set(one[1:]) <= set(two) and min(map(len, one[1:-1])) >= 2


@pytest.mark.parametrize("k", [2, 4, 8])
def test_planted_passages_go_and_clean_texts_stay(spark, k):
    """Passages of k lines, or of k sentences in the middle of a line, in otherwise different documents."""
    rng = np.random.default_rng(k)

    def own(n):
        return [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 6)) for _ in range(n)]

    docs, planted = [], []
    for i in range(120):
        passage = own(k)
        for side in range(2):
            if i % 2:
                text = "\n".join([*own(int(rng.integers(1, 6))), *passage, *own(int(rng.integers(1, 6)))])
            else:
                text = ". ".join([*own(3), *passage, *own(3)]) + "."
            docs.append((2 * i + side, text))
            planted.append(passage)
    clean = [(1000 + i, "\n".join(own(9))) for i in range(50)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r["text"] for r in remove_repeated_lines(df).collect()}
    assert all(out[d] == t for d, t in clean) and all(out[d] == t for d, t in docs[::2])
    gone = [line not in out[d] for d, _ in docs[1::2] for line in planted[d]]
    assert np.mean(gone) >= 0.9
    assert all(len(units(out[d])) == len(units(t)) - k for d, t in docs[1::2])


def test_copies_of_a_text_leave_the_first_alone(spark):
    body = "\n".join(f"a line of its own {i}" for i in range(40))
    df = spark.createDataFrame([(i, body) for i in range(300)] + [(500, "before\n" + body)], "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in remove_repeated_lines(df).collect()}
    assert out.pop(0) == (body, 0) and out.pop(500) == ("before\n", 40)
    assert set(out.values()) == {("", 40)}


def test_units_with_one_digest_and_different_bytes_stay(spark, monkeypatch):
    """All digests are made equal, so nothing may be removed."""
    real = L._part
    monkeypatch.setattr(L, "_part", lambda d, start, digits: real(d, start, digits) % 2)
    df = spark.createDataFrame([(i, "\n".join(f"text number {i} and {j}" for j in range(12))) for i in range(20)], "doc_id long, text string")
    assert all(r["n_removed_lines"] == 0 for r in remove_repeated_lines(df).collect())


def test_units_with_one_key_and_different_bytes_stay_and_others_go(spark, monkeypatch):
    """Keys say only whether a unit holds "x": units that share a key and differ in bytes stay wherever they repeat."""
    monkeypatch.setattr(L, "_key", lambda u: L.F.when(u.contains("x"), L.F.lit(1).cast("long")).otherwise(L.F.xxhash64(u)))
    rows = [(1, "first of x lines\nsecond of x lines"), (2, "third of x lines\nfourth of x lines"), (3, "a line that repeats\nanother that repeats"), (4, "a line that repeats\nanother that repeats")]
    out = {r["doc_id"]: r["text"] for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**dict(rows), 4: ""}


def test_only_places_that_repeat_are_compared_by_bytes(spark, monkeypatch):
    """Texts without a repeat don't reach the byte check."""
    seen = []
    real = L._unlike
    monkeypatch.setattr(L, "_unlike", lambda docs, places: seen.append(sorted(r["doc_id"] for r in places.select("doc_id").distinct().collect())) or real(docs, places))
    rows = [(i, f"own line number {i}\nown second line {i}\nown third line {i}") for i in range(9)] + [(20 + i, "a line that repeats\nanother that repeats") for i in range(2)]
    out = {r["doc_id"]: r["n_removed_lines"] for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen == [[20, 21]] and out == {**{i: 0 for i in range(9)}, 20: 0, 21: 2}


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"long line {i} of it" for i in range(20000))
    rows = [(1, None, 9), (2, "", 9), (None, long, 9), (4, long, 9), (4, long, 9), (5, "one", 9), (6, "one", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = sorted((str(r["doc_id"]), r["text"] if r["text"] is None or len(r["text"]) < 9 else "long", r["n_lines"]) for r in remove_repeated_lines(df).collect())
    assert got == sorted([("1", None, 0), ("2", "", 0), ("None", "long", 20000), ("4", "", 20000), ("4", "", 20000), ("5", "one", 1), ("6", "one", 1)], key=lambda r: r[0])
    assert remove_repeated_lines(df.limit(0)).count() == 0
    assert remove_repeated_lines(df).columns == ["doc_id", "text", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks"]
