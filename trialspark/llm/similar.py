"""Near-duplicate documents: SimHash with pivot distance tables, checked by the Jaccard similarity of shingle sets.

Candidates come from the fingerprints and pivot tables of ``simhash``. Texts around the threshold differ
in more bits than those find, so MinHash signatures add to them: documents that agree in a whole band of
values meet, and pairs of a bucket whose signatures agree often enough are candidates too. A candidate
is a link only if the shingle sets themselves are similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import lean, text_of, utf8
from trialspark.llm.components import connected_components
from trialspark.llm.simhash import REACH, fingerprint_links, shingle_hashes, vote
from trialspark.shared import gather

WORDS = 5
SIMILARITY = 0.8
BLOCK = 1 << 14  # rows of signatures compared at a time
BANDS, BAND_ROWS = 32, 8  # a pair at 0.8 agrees in some band with 1 - (1 - 0.8^8)^32 = 0.997
SLACK = 2.9  # deviations below the expected agreement up to which a pair is a candidate: 0.998 of those at the threshold
NEIGHBOURS = 16  # of a bucket that a document is compared with at first
FACTORS = np.random.default_rng(17).integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of distinct shingle hashes, one for each of ``FACTORS``: two sets agree in one with their Jaccard similarity."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, np.multiply.outer(FACTORS, low[at : at + 4096]).min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray) -> list[int]:
    """One signed long for each band of a signature."""
    raw, size = values.tobytes(), 4 * BAND_ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[size * i : size * (i + 1)], i) for i in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def least_agreeing(similarity: float) -> int:
    """Smallest number of equal signature values that makes a pair a candidate."""
    n = len(FACTORS)
    return int(n * similarity - SLACK * math.sqrt(n * similarity * (1 - similarity)))


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, k, print`` (digest of the set of shingles), ``fp`` (SimHash), ``bands`` and ``sketch`` (a byte of each signature value)."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", text_of()).alias("k"), utf8().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, votes, bands, sketches = [], [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), words)
                votes.append(vote(hashes))
                found = np.unique(hashes)
                values = signature(found)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(values) if len(found) else [])
                sketches.append((values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            fps = pa.array(np.array(votes, np.uint64).view(np.int64))
            cols = [pa.array(prints, pa.binary()), fps, pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=["doc_id", "k", "print", "fp", "bands", "sketch"])

    return rows.mapInArrow(lean(run), "doc_id long, k long, print binary, fp long, bands array<long>, sketch binary")


def fingerprint_pairs(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs ``a < b`` of prints whose fingerprints are equal or linked by the pivot tables.

    Each fingerprint stands for its smallest print, to which its other prints are paired; links between
    fingerprints are those of ``fingerprint_links``.
    """
    faces = prints.select("print", "fp").distinct()
    named = gather(faces.groupBy("fp").agg(F.min("print").alias("head")))
    same = faces.join(named, "fp").select(F.col("head").alias("x"), F.col("print").alias("y"))
    links = fingerprint_links(named.select("fp"), reach)
    one, two = (named.select(F.col("fp").alias(c), F.col("head").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    pairs = same.unionByName(links.join(one, "a").join(two, "b").select("x", "y")).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``print, shingles`` (distinct hashes) of the ``wanted`` prints, read from the document ``first`` of each."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", text_of()).alias("k"), utf8().alias("body"))
    at = wanted.select("print", F.col("first.doc_id").alias("__d"), F.col("first.k").alias("__k"))
    texts = rows.join(at, (F.col("k") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select("print", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["print", "shingles"])

    return texts.mapInArrow(lean(run), "print binary, shingles array<long>").dropDuplicates(["print"])  # a row may be there twice


def _table(prints: pa.Array) -> np.ndarray:
    raw = prints.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), len(raw[0]) if raw else 0)


def neighbours(table: np.ndarray, bucket: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the one of the next ``NEIGHBOURS`` of its bucket that agrees most, if in ``least`` values."""
    ends = np.searchsorted(bucket, bucket, side="right")
    best, other = np.full(len(table), least - 1), np.zeros(len(table), np.int64)
    for lag in range(1, NEIGHBOURS + 1):
        i = np.flatnonzero(np.arange(len(table)) + lag < ends)
        for part in np.array_split(i, len(i) // BLOCK + 1):
            same = (table[part] == table[part + lag]).sum(axis=1)
            more = same > best[part]
            best[part[more]], other[part[more]] = same[more], part[more] + lag
    i = np.flatnonzero(best >= least)
    return i, other[i]


def between(table: np.ndarray, bucket: np.ndarray, root: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket that have different roots (numbers) and agree in ``least`` values.

    Rows outside the commonest root of their bucket are compared with the whole bucket, so that a large
    group that is joined already costs nothing.
    """
    starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else []
    for start, stop in zip(starts, [*starts[1:], len(bucket)], strict=True):
        roots, counts = np.unique(root[start:stop], return_counts=True)
        for i in start + np.flatnonzero(root[start:stop] != roots[counts.argmax()]):
            for at in range(start, stop, BLOCK):
                j = np.arange(at, min(at + BLOCK, stop))
                j = j[root[j] != root[i]]
                j = j[(table[j] == table[i]).sum(axis=1) >= least]
                if len(j):
                    yield np.full(len(j), i), j


def _by_bucket(members: DataFrame, pairs) -> DataFrame:
    """Pairs ``a < b`` of prints that ``pairs(table, bucket, root)`` yields positions of; ``members`` has ``key, print, sketch, root``."""

    def settle(held: pa.Table) -> Iterator[pa.RecordBatch]:
        key = held.column(0).to_numpy()
        bucket = np.cumsum(np.append(0, np.diff(key) != 0))
        prints, names = held.column(1).to_pylist(), held.column(3).to_pylist()
        number = {name: n for n, name in enumerate(dict.fromkeys(names))}
        root = np.array([number[name] for name in names])
        for i, j in pairs(_table(held.column(2)), bucket, root):
            ends = [sorted((prints[x], prints[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            yield pa.record_batch([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            changes = np.flatnonzero(np.diff(key))
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield from settle(pa.Table.from_batches(held))
                held = []
            last = int(changes[-1]) + 1 if len(changes) else 0  # the last bucket may go on in the next batch
            if last:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from settle(pa.Table.from_batches(held))

    dealt = members.select("key", "print", "sketch", "root").repartition("key").sortWithinPartitions("key", "sketch")
    return dealt.mapInArrow(lean(run), "a binary, b binary").distinct()


def _true_links(candidates: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets of shingles have at least this Jaccard similarity."""
    ends = candidates.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    sets = gather(_sets(docs, distinct.select("print", "first").join(ends, "print"), words))
    one, two = (sets.select(F.col("print").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    share = both / (F.size("sa") + F.size("sb") - both)
    return candidates.join(one, "a").join(two, "b").filter(share >= similarity).select("a", "b")


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of similar ones: the one with the smallest id.

    Documents are similar when their sets of ``words``-word shingles have at least this Jaccard
    ``similarity``; groups are the connected components of such pairs. Links are decided on the sets
    themselves, so nothing else joins a group. Candidates are the links of SimHash fingerprints within ``REACH`` bits,
    and by MinHash a pair at the threshold 0.8 is looked at with a chance of
    0.995 or more by the choice of bands and slack, a closer one more surely. Documents without words
    (NULL, empty) are equal to each other. A NULL id stays only where a group has no other; of rows that
    repeat both id and text one stays. Columns are unchanged.
    """
    least = least_agreeing(similarity)
    prints = gather(_prints(docs, words))
    order = F.struct(F.col("doc_id").isNull().alias("gap"), "doc_id", "k")
    distinct = gather(prints.groupBy("print").agg(F.min(order).alias("first"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")))
    spots = distinct.select("print", F.explode("bands").alias("key"))
    shared = spots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = gather(spots.join(shared, "key").join(distinct.select("print", "sketch"), "print"))
    own = members.withColumn("root", F.col("print"))
    close = _by_bucket(own, lambda table, bucket, root: [neighbours(table, bucket, least)])
    tried = gather(fingerprint_pairs(prints).unionByName(close).distinct())
    links = gather(_true_links(tried, distinct, docs, words, similarity))
    # pairs that no link found so far ties together, where the likeliest ones were not enough
    found = gather(connected_components(links)).withColumnRenamed("node", "print")
    joined = members.join(found, "print", "left").withColumn("root", F.coalesce("root", "print"))
    rest = gather(_by_bucket(joined, lambda table, bucket, root: between(table, bucket, root, least)).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(_true_links(rest, distinct, docs, words, similarity))
    roots = gather(connected_components(links))
    placed = distinct.join(roots, distinct["print"] == roots["node"], "left").select("first", F.coalesce("root", "print").alias("root"))
    keep = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__d"), F.col("first.k").alias("__k"))
    copies = prints.groupBy("doc_id", "k").agg(F.count("*").alias("__n")).select(F.col("doc_id").alias("__d2"), F.col("k").alias("__k2"), "__n")
    keep = keep.join(copies, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__k") == F.col("__k2"))).select("__d", "__k", "__n")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", text_of()))
    left = keyed.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")))
    once = left.filter("__n = 1").select(*docs.columns)
    return once.unionByName(left.filter("__n > 1").dropDuplicates(["doc_id", "__key"]).select(*docs.columns))
