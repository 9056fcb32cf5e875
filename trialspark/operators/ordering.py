"""Exact positions, running sums and average ranks that never put a whole large group in one task.

Narrow rows are written once and range-partitioned by (group, order) into slices of bounded size, whose
places are fixed by writing them. A row's running value is the total of its group's earlier slices plus
the one inside its slice, whatever the size of the group; a table of no more rows than one slice is that
slice. Every row is kept: NULL is a group and a value of its own, ranked lowest, and NaN ranks highest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.shared import materialize, null_safe_join

SPLIT_ROWS = 1 << 16  # rows of a slice: one sort of as many narrow rows is a small task


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once, and its number of rows from the files' footers."""
    table = materialize(df)
    return table, table.count()


def running_sums(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column],
    split_rows: int = SPLIT_ROWS,
    known: int | None = None,
    maxima: dict[str, Column] | None = None,
    maxima_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums (and maxima) in ``order`` within ``group``; ``order`` must be total.

    ``maxima_before`` are maxima over earlier rows only. ``known`` is an upper bound on the rows of a table that is cheap to read again; without it ``df`` is
    written and counted first.
    """
    if known is None:
        df, known = counted(df)
    maxima, earlier = maxima or {}, maxima_before or {}
    start, here = Window.unboundedPreceding, Window.currentRow
    slices = max(1, math.ceil(known / split_rows))
    if slices == 1:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(start, here)
        past = Window.partitionBy(*group).orderBy(*order).rowsBetween(start, -1)
        added = {n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.max(c).over(w) for n, c in maxima.items()}
        return df.withColumns(added | {n: F.max(c).over(past) for n, c in earlier.items()})

    weighted = df.withColumns({f"__w_{n}": c for n, c in (sums | maxima | earlier).items()})
    ranged = materialize(
        weighted.repartitionByRange(slices, *[F.col(g) for g in group], *order).withColumn(
            "__slice", F.spark_partition_id()
        )
    )
    fold = {n: F.sum for n in sums} | {n: F.max for n in maxima | earlier}
    by_slice = ranged.groupBy(*group, "__slice").agg(*[f(f"__w_{n}").alias(f"__t_{n}") for n, f in fold.items()])
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(start, -1)
    offsets = by_slice.select(*group, "__slice", *[f(f"__t_{n}").over(before).alias(f"__o_{n}") for n, f in fold.items()])
    inside = Window.partitionBy("__slice", *group).orderBy(*order).rowsBetween(start, here)
    past = Window.partitionBy("__slice", *group).orderBy(*order).rowsBetween(start, -1)
    local = ranged.withColumns({f"__l_{n}": f(f"__w_{n}").over(past if n in earlier else inside) for n, f in fold.items()})
    joined = null_safe_join(local, offsets, [*group, "__slice"])
    # like a window's sum: NULL only as long as every value so far is NULL
    total_sums = {n: F.coalesce(F.col(f"__l_{n}") + F.col(f"__o_{n}"), f"__l_{n}", f"__o_{n}") for n in sums}
    total_max = {n: F.greatest(f"__l_{n}", f"__o_{n}") for n in maxima | earlier}
    return joined.withColumns(total_sums | total_max).select(*df.columns, *fold)


def positions(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    out: str = "position",
    split_rows: int = SPLIT_ROWS,
    known: int | None = None,
) -> DataFrame:
    """1-based ordinal position within ``group``."""
    return running_sums(df, group, order, {out: F.lit(1).cast("long")}, split_rows, known)


def _beginning(digest: Column, rows: int, split_rows: int) -> Column:
    """So many digits of a hex digest that rows with the same ones are about ``split_rows`` at most; '' for NULL, which comes first."""
    digits = 1
    while 16**digits * split_rows < rows:
        digits += 1
    return F.coalesce(F.substring(digest, 1, digits), F.lit(""))


def lowest(df: DataFrame, digest: Column, order: list[Column], n: int, rows: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The ``n`` rows of ``df`` that are first by a hex ``digest`` and then by ``order``.

    ``rows`` is their number or more. They are counted by the beginning of the digest, so that only those of the
    beginning where the cut lies are ordered; all others are kept or left where they are read. ``df`` is read three times.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    if n >= rows:
        return df
    begins = _beginning(digest, rows, split_rows)
    sizes, known = counted(df.groupBy(begins.alias("__begins")).agg(F.count(F.lit(1)).alias("__n")))
    cut = running_sums(sizes, [], [F.col("__begins")], {"__upto": F.col("__n")}, split_rows, known).filter(F.col("__upto") >= n).orderBy("__upto").first()
    if cut is None:  # fewer rows than said
        return df
    before = df.filter(begins < F.lit(cut["__begins"]))
    at = df.filter(begins == F.lit(cut["__begins"])).withColumn("__digest", digest)
    placed = positions(at, [], [F.col("__digest"), *order], "__place", split_rows)
    return before.unionByName(placed.filter(F.col("__place") <= n - cut["__upto"] + cut["__n"]).select(*df.columns))


def digest_positions(df: DataFrame, digest: Column, order: list[Column], out: str, rows: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """1-based position of every row by a hex ``digest`` and then by ``order``, which must be total.

    Rows are counted and dealt by the beginning of the digest, so that they are shuffled once, without their digests, and
    nothing of their number is written besides. ``rows`` is about their number. ``df`` is read twice.
    """
    begins = _beginning(digest, rows, split_rows)
    sizes, known = counted(df.groupBy(begins.alias("__begins")).agg(F.count(F.lit(1)).alias("__n")))
    upto = running_sums(sizes, [], [F.col("__begins")], {"__upto": F.col("__n")}, split_rows, known)
    offsets = upto.select("__begins", (F.col("__upto") - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("__begins").orderBy(F.col("__digest"), *order)
    dealt = df.repartition(begins).withColumns({"__begins": begins, "__digest": digest})
    placed = dealt.withColumn("__place", F.row_number().over(inside)).join(offsets, "__begins")
    return placed.select(*df.columns, (F.col("__before") + F.col("__place")).alias(out))


def dense_codes(
    df: DataFrame,
    group: list[str],
    value: str,
    out: str,
    split_rows: int = SPLIT_ROWS,
    known: int | None = None,
) -> DataFrame:
    """Distinct values of ``value`` per group with a 0-based code in ascending order."""
    return positions(df.select(*group, value).distinct(), group, [F.col(value)], out, split_rows, known).withColumn(out, F.col(out) - 1)


def dense_ranks(df: DataFrame, group: list[str], value: str, out: str, split_rows: int = SPLIT_ROWS, known: int | None = None) -> DataFrame:
    """Add the 0-based dense rank of ``value`` within ``group``."""
    if known is None:
        df, known = counted(df)
    return null_safe_join(df, dense_codes(df, group, value, out, split_rows, known), [*group, value])


def average_ranks(
    df: DataFrame,
    group: list[str],
    value: str,
    out: str,
    split_rows: int = SPLIT_ROWS,
    known: int | None = None,
) -> DataFrame:
    """Add 1-based ranks where ties share their mean rank.

    Equal values collapse to one counted row before anything is ordered, so a frequent value is not
    a heavy slice; its rank goes back to its rows by a join, which splits at run time where a value is hot.
    """
    if known is None:
        df, known = counted(df)
    ties = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__ties"))
    cum = running_sums(ties, group, [F.col(value)], {"__upto": F.col("__ties")}, split_rows, known)
    ranked = cum.select(*group, value, (F.col("__upto") - (F.col("__ties") - 1) / 2.0).alias(out))
    return null_safe_join(df, ranked, [*group, value])


def medians(df: DataFrame, group: list[str], value: str, out: str = "median", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Exact median of the non-NULL values per group: ``(group…, out)``, NULL for a group without any.

    Distinct values are counted and their running counts say where the middle lies, so no task
    holds the values of a group.
    """
    counts, rows = counted(df.groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    held = counts.filter("__v is not null")
    upto = running_sums(held, group, [F.col("__v")], {"__upto": F.col("__c")}, split_rows, rows)
    sizes = counts.groupBy(*group).agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))).alias("__n"))
    placed = null_safe_join(upto, sizes, group)
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")
    middle = placed.groupBy(*group).agg(
        (F.min(F.when(F.col("__upto") > low, F.col("__v"))) * 0.5 + F.min(F.when(F.col("__upto") > high, F.col("__v"))) * 0.5).alias(out)
    )
    return null_safe_join(sizes.select(*group), middle, group, "left") if group else middle
