"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bit votes over the hashes of word shingles. Two that differ in at most ``reach``
bits agree on all but ``reach`` of ``BLOCKS`` blocks, so each choice of the other blocks makes a
bucket. Inside a bucket each fingerprint has a row of Hamming distances to fixed reference
fingerprints (pivots): by the triangle inequality, pairs with a coordinate that differs by more than
``reach`` are discarded, and the survivors are verified. A bucket reports a star, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query, utf8
from trialspark.llm.components import connected_components
from trialspark.shared import materialize

BLOCKS = 8  # of 8 bits: a bucket leaves 16 bits open, so it holds at most 65,536 fingerprints
REACH = 2
SEED = 42
PIVOTS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 ^ 0xD1B54A32D192ED03 * (i + 7)) & (1 << 64) - 1 for i in range(12)], np.uint64)
BITS = 64 * 16384


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words; of the whole sequence when it is shorter; none without words."""
    found = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def vote(h: np.ndarray) -> int:
    """Each bit is 1 if more than half of the hashes have it; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), BITS // 64):
        part = h[at : at + BITS // 64].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The vote of all shingle hashes, repeats included; 0 for a text without words."""
    return vote(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``) and ``fp``, the fingerprint as a signed long."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, utf8().alias("__text"))
    schema = rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(prints.view(np.int64))], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def _bucket_keys(reach: int) -> list[Column]:
    """One key per choice of blocks that must agree: the choice's number and the bits of its blocks."""
    size = 64 // BLOCKS
    keys = []
    for number, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - reach)):
        mask = sum(((1 << size) - 1) << (size * b) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return keys


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def linked(prints: np.ndarray, bucket: np.ndarray, reach: int) -> np.ndarray:
    """For each distinct fingerprint (sorted by bucket number) the position of its group's first member.

    Rows of a bucket are put in order of their distance to the first pivot, so that a row stops
    looking once that coordinate is more than ``reach`` ahead. Rows compared at a time are as many as
    there are fingerprints, and found links are folded into the groups at once.
    """
    n = len(prints)
    table = np.stack([_popcount(prints ^ p) for p in PIVOTS])
    order = np.lexsort((table[0], bucket))
    x, b, t = prints[order], bucket[order], table[:, order]
    group = np.arange(n)
    active, lag = np.arange(n), 1
    while len(active):
        active = active[active + lag < n]
        other = active + lag
        near = (b[active] == b[other]) & (t[0][other] - t[0][active] <= reach)
        active, other = active[near], other[near]
        keep = np.ones(len(active), bool)
        for row in t[1:]:
            keep &= np.abs(row[active] - row[other]) <= reach
        i, j = active[keep], other[keep]
        true = _popcount(x[i] ^ x[j]) <= reach
        _fold(group, i[true], j[true])
        lag += 1
    out = np.empty(n, np.int64)
    out[order] = order[group]
    return out


def _fold(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge groups along links until each row points at the smallest position of its group."""
    while len(i):
        a, b = group[i], group[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(group, a, low)
        np.minimum.at(group, b, low)
        while True:
            up = group[group]
            if np.array_equal(up, group):
                break
            group[:] = up


def fingerprint_links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """Links ``a, b`` between distinct ``fp`` values at most ``reach`` bits apart, as stars per bucket.

    Stars of all buckets together connect exactly the fingerprints that the pairs would connect.
    """
    keyed = distinct.select("fp", F.explode(F.array(*_bucket_keys(reach))).alias("key"))
    dealt = keyed.select("fp", F.col("key.choice").alias("choice"), F.col("key.bits").alias("bits"))
    dealt = dealt.repartition(F.col("choice"), F.col("bits")).sortWithinPartitions("choice", "bits")

    def emit(fp: np.ndarray, choice: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.concatenate([[0], (np.diff(choice) != 0) | (np.diff(bits) != 0)]))
        several = np.bincount(bucket)[bucket] > 1
        fp, bucket = fp[several], bucket[several]
        root = linked(fp.view(np.uint64), bucket, reach) if len(fp) else np.zeros(0, np.int64)
        moved = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            new = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            changes = np.flatnonzero((np.diff(new[1]) != 0) | (np.diff(new[2]) != 0))
            last = int(changes[-1]) + 1 if len(changes) else 0  # the last bucket may go on in the next batch
            if last:
                yield emit(*(x[:last] for x in new))
            held = [x[last:] for x in new]
        if len(held[0]):
            yield emit(*held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = REACH) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of each document.

    Documents whose fingerprints are within ``reach`` bits, directly or through others, share a
    component, named by its smallest ``doc_id`` (NULL if all its ids are NULL). NULL and empty texts
    have fingerprint 0 and link like any other. Copies collapse to one fingerprint before the
    search, so a hot group costs one row there. Repeated rows are all returned.
    """
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = materialize(connected_components(fingerprint_links(distinct, reach)))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = materialize(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


@query("op5_simhash_pivots")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
