import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from trialspark.llm import decontaminate as decontaminate_module
from trialspark.llm.decontaminate import decontaminate, op8, scan_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, owners = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if found := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    owners |= found
        sha = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(owners), sha, bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in op8(spark, sf).collect()), key=str)
    assert got == slow(docs, items) and any(r[5] for r in got)


def test_blocks_short_items_overlaps_and_odd_texts(spark):
    rng = np.random.default_rng(3)
    w = ["Ab", "é", "c3", "d", "E"]
    docs = [(i % 50, " ".join(rng.choice(w, 60))) for i in range(60)] + [(70, None), (71, ""), (None, "-- ."), (72, "ab,É;" * 9000)]
    items = [(i, "-".join(rng.choice(w, int(rng.integers(0, 7))))) for i in range(25)] + [(99, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as items", "'x' as spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [r[:4] for r in slow(docs, items, 4)]
    for block in (3, 1000):
        got = [(r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["items"])) for r in scan_documents(d, b, 4, block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert scan_documents(d.limit(0), b, 4).count() == 0
    assert {tuple(r["spans"]) for r in scan_documents(d, b.limit(0), 4).collect()} == {()}


def test_spans_are_cut_and_clean_documents_stay(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {passage.upper()}! After.", 4), (2, "clean text - é", 5), (3, passage, 6), (4, None, 7), (5, "", 8), (2, "clean text - é", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, spans int")
    b = spark.createDataFrame([("x", passage)], "item_id string, text string")
    got = decontaminate(d, b)
    assert got.columns == d.columns
    clean = [(2, "clean text - é", 5), (2, "clean text - é", 5), (4, None, 7), (5, "", 8)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "Before, ! After.", 4), *clean], key=str)
    assert sorted(map(tuple, decontaminate(d, b, "documents").collect()), key=str) == sorted(clean, key=str)


def test_many_windows_are_screened_in_one_scan(spark):
    """A block of 20 and 400 windows and more: at most two Python steps, same spans and items as with all windows broadcast."""
    rng = np.random.default_rng(5)
    w = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(w, 30))) for i in range(20)] + [(50, "short item"), (51, "short item"), (52, None)]
    docs = [(i, " ".join([*rng.choice(w, 15), *items[i % 20][1].split()[4:18], *rng.choice(w, 15)])) for i in range(40)]
    docs += [(100, "a short item!"), (101, None), (102, ""), (None, items[3][1]), (103, items[3][1]), (103, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")

    def rows(df):
        return sorted((str(r["doc_id"]), r["n_words"], str(r["spans"]), str(r["items"])) for r in df.collect())

    screened = scan_documents(d, b, block=20)
    assert rows(screened) == rows(scan_documents(d, b)) and sum(bool(r["spans"]) for r in screened.collect()) == 44
    plan = screened._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("MapInArrow") <= 2


def test_bits_are_found_where_spark_sets_them(spark):
    prints = np.array([0, 1, 2, 32767, 32768, 32769, 65536, 2**40 + 5, 2**63 - 1, 2**64 - 1, 2**64 - 32768], np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    whole = decontaminate_module._bitmap(df)
    assert decontaminate_module._passes(whole, prints).all()
    assert not decontaminate_module._passes(whole, np.array([3, 32770, 99999, 2**63 - 9], np.uint64)).any()
