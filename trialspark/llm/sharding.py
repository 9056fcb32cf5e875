"""Sharding by sampled splitters (DataFrame functions only).

Size-weighted key samples give quantile boundaries, records are range-partitioned by them, overfull
ranges get splitters of their own, and running sizes inside the small ranges place each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query, text_of, utf8
from trialspark.shared import materialize

SHARDS = 8
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 64


def _sample(rows: DataFrame, wanted: int, total: int) -> DataFrame:
    """Keys drawn in proportion to size: each row gives floor(size·rate + u) draws, u from its key's hash."""
    u = (F.xxhash64("key").bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    draws = F.floor(F.col("size") * F.lit(wanted / max(total, 1)) + u)
    return rows.select("key", draws.alias("draws")).filter("draws > 0")


def _quantile_keys(sample: list, parts: int) -> list[bytes]:
    """Boundaries that cut the sampled draws into ``parts`` near-equal runs."""
    total = sum(r["draws"] for r in sample)
    cuts, seen, part = [], 0, 1
    for r in sample:
        seen += r["draws"]
        while part < parts and seen * parts >= total * part:
            if not cuts or cuts[-1] != r["key"]:
                cuts.append(r["key"])
            part += 1
    return cuts


def range_of(key: Column, cuts: list[bytes]) -> Column:
    """Number of splitters below the key, by binary search over the constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    array = F.array(*[F.lit(bytearray(c)) for c in cuts])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(array, at + step - 1) < key, at + step).otherwise(at),
    )


def splitters(rows: DataFrame, ranges: int, samples: int = SAMPLES_PER_RANGE) -> list[bytes]:
    """Sorted boundary keys whose ranges hold at most twice their even share of bytes.

    The sample is ``ranges × samples`` draws, whatever the input size. A range found overfull after
    measuring is sampled again on its own, until none is left; a range of one single key cannot be cut
    further. Where only the largest key of a range is drawn, the range is cut below that key.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    share = max(1, total // ranges)
    cuts = _quantile_keys(_sample(rows, ranges * samples, total).orderBy("key").collect(), ranges)
    while True:  # each round cuts every overfull range at least once
        measured = rows.groupBy(range_of(F.col("key"), cuts).alias("r")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        overfull = measured.filter((F.col("b") > 2 * share) & (F.col("lo") < F.col("hi"))).collect()
        if not overfull:
            return cuts
        more: list[bytes] = []
        for r in overfull:  # at most ranges / 2 of them, as each holds two shares
            inside = rows.filter(F.col("key").between(F.lit(r["lo"]), F.lit(r["hi"])))
            parts = -(-r["b"] // share)
            got = _quantile_keys(_sample(inside, parts * samples, r["b"]).orderBy("key").collect(), parts)
            more += [k for k in got if r["lo"] <= k < r["hi"]] or [inside.filter(F.col("key") < F.lit(r["hi"])).agg(F.max("key").alias("k")).first()["k"]]
        cuts = sorted({bytes(c) for c in [*cuts, *more]})


def assign_shards(rows: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Add ``shard`` (0 to shards − 1) and ``slot`` (gapless from 0 in each shard) to narrow rows.

    ``rows`` needs a binary ``key`` that orders the records (end it with a unique id, so that a hot
    value can be cut) and a non-negative long ``size``; other columns pass through. A record goes to
    the shard that holds its middle byte in key order, so that shards differ from the even share by
    less than one record at each end. Rows with equal keys stay in one range. An empty input
    gives no rows. Sizes of zero are allowed; if all are zero everything is in shard 0.
    """
    cuts = splitters(rows, shards * ranges_per_shard)
    placed = rows.withColumn("__range", range_of(F.col("key"), cuts))
    totals = placed.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range: a fixed number
    starts = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows0"),
        F.sum("__bytes").over(W.partitionBy(F.lit(1))).alias("__total"),
    )
    within = W.partitionBy("__range").orderBy("key", "size")
    run = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = (
        placed.withColumn("__done", F.sum("size").over(run))
        .withColumn("__nth", F.row_number().over(within))
        .join(F.broadcast(starts), "__range")
    )
    middle = 2 * (F.col("__bytes0") + F.col("__done")) - F.col("size")
    shard = F.coalesce(F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("__total")))), F.lit(0))
    ordered = materialize(
        numbered.withColumn("shard", shard.cast("int")).withColumn("__row", F.col("__rows0") + F.col("__nth") - 1)
    )
    firsts = ordered.groupBy("shard").agg(F.min("__row").alias("__first"))
    return (
        ordered.join(F.broadcast(firsts), "shard")
        .withColumn("slot", (F.col("__row") - F.col("__first")).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Narrow rows of documents: id, size, checksum and the sort key (checksum, id), big-endian.

    Equal texts have neighbouring keys and so share a shard unless a boundary falls among them.
    """
    t = utf8()
    crc = F.crc32(t)
    key = F.concat(
        F.unhex(F.lpad(F.hex(crc), 8, "0")),
        F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))),
        F.unhex(F.lpad(F.hex(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")),
    )
    return docs.select("doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"), crc.alias("text_crc32"), key.alias("key"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each document, near equal in bytes; NULL texts count one byte.

    Columns other than ``doc_id`` and ``text`` are not read, repeated ids get slots of their own.
    """
    rows = materialize(document_rows(docs.select("doc_id", "text")))
    return assign_shards(rows, shards).drop("key")


@query("op10_sampled_splitters")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(documents(spark, sf)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
