"""Exact deduplication of incoming batches against immutable snapshots.

A snapshot keeps its distinct digests in shards, each with a static binary-fuse filter. Incoming
digests are first grouped among themselves, then screened by the filter of their shard; only the
positives join the exact buckets of the snapshot. Every bucket with more than one text is proved
equal by comparing bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import fuse
from trialspark.llm.common import crc_bucket, documents, query, text_of
from trialspark.shared import materialize

SHARD_DIGESTS = 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; NULL counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``sha``, the SHA-256 of the normalised text in UTF-8 as lower-case hex."""
    return docs.select("doc_id", F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("sha"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest of a batch: smallest id and number of rows (hot digests combine map-side)."""
    return rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def _shard(shards: int) -> Column:
    """Shard from digits that the filter keys don't use."""
    return (F.conv(F.substring("sha", 33, 8), 16, 10).cast("long") % shards).cast("int")


def _keys(sha: pd.Series) -> np.ndarray:
    raw = bytes.fromhex("".join(s[:16] for s in sha))
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One filter row per shard of a snapshot; a shard holds about ``SHARD_DIGESTS`` digests at most."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(_keys(pdf["sha"]))
        return pd.DataFrame({"shard": [key[0]], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return groups.select(_shard(shards).alias("shard"), "sha").groupBy("shard").applyInPandas(one, "shard int, seed string, segment int, segments int, prints binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Digests of a batch that the snapshot's filters don't rule out."""

    def probe(pdf: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        if not len(filt) or not len(pdf):
            return pdf[["sha"]].iloc[:0]
        row = filt.iloc[0]
        f = fuse.Filter(int(row["seed"]), int(row["segment"]), int(row["segments"]), np.frombuffer(row["prints"], np.uint16))
        return pdf.loc[f.holds(_keys(pdf["sha"])), ["sha"]]

    left = groups.select(_shard(shards).alias("shard"), "sha").groupBy("shard")
    return left.cogroup(filters.groupBy("shard")).applyInPandas(probe, "sha string")


def ingest(snapshot: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Groups of the snapshot after a batch: ``sha``, ``first_id`` (smallest id so far), ``n`` (rows so far).

    ``snapshot`` is an earlier result of this function (written, so immutable) and ``batch`` has
    ``doc_id`` and ``sha``. Duplicates inside the batch are grouped first, apart from the snapshot.
    Without a snapshot, or with an empty one, the batch's own groups are returned. NULL ids never
    win over other ids.
    """
    own = grouped(batch)
    if snapshot is None:
        return own
    own = materialize(own)
    held = snapshot.count()
    shards = max(1, -(-max(held, own.count()) // SHARD_DIGESTS))
    filters = materialize(build_filters(snapshot, shards))
    positives = screen(own, filters, shards)
    hits = positives.join(own, "sha").join(snapshot.select("sha", F.col("first_id").alias("old_id"), F.col("n").alias("old_n")), "sha")
    merged = materialize(hits.select("sha", F.least("first_id", "old_id").alias("first_id"), (F.col("n") + F.col("old_n")).alias("n")))
    fresh = own.join(merged.select("sha"), "sha", "left_anti")
    untouched = snapshot.join(merged.select("sha"), "sha", "left_anti")
    return merged.unionByName(fresh).unionByName(untouched.select("sha", "first_id", "n"))


def byte_check(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Digests of ``repeated`` whose texts are not all the same bytes (none are expected).

    The smallest and the largest text of a bucket are equal exactly if all are; both are combined
    before the shuffle, so that a hot bucket moves one row per task.
    """
    texts = docs.select(F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("sha"), normalised().alias("body"))
    spread = texts.join(repeated.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    return spread.filter("lo <> hi").select("sha")


def deduplicate(docs: DataFrame, batch_of: Column, batches: int) -> DataFrame:
    """Ingest ``docs`` batch by batch; one row per document, dropped ones too.

    ``batch_of`` gives each row's batch (0 to batches − 1); the result doesn't depend on it. Columns:
    ``doc_id, keep_id, group_size, kept, text_sha256``. NULL texts are empty texts. Rows that repeat
    an id and its text are one group of that size and are all marked as kept when their id stays.
    NULL ids are kept only where a group has no other. Other columns of ``docs`` are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = materialize(digests(docs).withColumn("batch", batch_of))
    snapshot = None
    for b in range(batches):
        snapshot = materialize(ingest(snapshot, rows.filter(F.col("batch") == b)))
    unequal = materialize(byte_check(docs, snapshot.filter("n > 1")))
    if not unequal.isEmpty():
        raise ValueError("two different texts share a SHA-256 digest")
    groups = snapshot.select("sha", F.col("first_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"))
    return rows.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


ORACLE = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as sha from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, sha as text_sha256
from d window g as (partition by sha)
"""


@query("op1_fuse_screened_dedup", ORACLE)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicate(documents(spark, sf), crc_bucket("doc_id", 2), 2)
