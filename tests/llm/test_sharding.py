import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm.sharding import SHARDS, op10, range_of, shard_documents, splitters


def slow(docs, shards=SHARDS):
    """(doc_id, size, crc, shard, slot) of each row: in key order, by the shard of its middle byte."""
    rows = [(zlib.crc32((t or "").encode()), d is not None, d or 0, len((t or "").encode()) + 1, d) for d, t in docs]
    total, done, slots, out = sum(r[3] for r in rows), 0, [0] * shards, []
    for crc, _, _, size, d in sorted(rows, key=lambda r: r[:4]):
        shard = min(shards - 1, (2 * done + size) * shards // (2 * total))
        out.append((d, size, crc, shard, slots[shard]))
        slots[shard] += 1
        done += size
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op10(spark, sf)) == slow(docs)


@pytest.mark.parametrize("kind", ["odd", "hot", "one", "huge"])
def test_odd_hot_and_huge_groups_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    docs = {
        "odd": [(None, None), (None, None), (1, None), (2, ""), (2, ""), (-5, "é"), (None, "b"), (3, "x" * 40)],
        "hot": [(i, "the same text" if i % 3 else "t" * int(rng.integers(0, 90))) for i in range(900)],
        "one": [(7, "alone")],
        "huge": [(i, "h" * 50000 if i == 100 else str(i)) for i in range(300)],
    }[kind]
    got = shard_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == slow(docs)
    sizes, largest = np.zeros(SHARDS), max(len((t or "").encode()) + 1 for _, t in docs)
    slots = {}
    for _, size, _, shard, slot in rows_of(got):
        sizes[shard] += size
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(sizes - sizes.sum() / SHARDS)) <= 2 * largest


def test_no_rows(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("heavy", [(60,), (60, 120, 121), (0,), (149,)])
def test_no_range_of_several_keys_is_overfull(spark, heavy):
    """Many keys of no size before and after a heavy one, of which only the heavy one is drawn."""
    sizes = [5000 if i in heavy else int(i % 50 == 7) for i in range(150)]
    rows = spark.createDataFrame([(bytearray(i.to_bytes(2, "big")), s) for i, s in enumerate(sizes)], "key binary, size long")
    cuts = splitters(rows, 16, samples=2)
    assert cuts == sorted(set(cuts))
    ranges = rows.groupBy(range_of(F.col("key"), cuts)).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 2 * (sum(sizes) // 16) or r["n"] == 1 for r in ranges)
