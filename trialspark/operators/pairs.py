"""Pair statistics inside groups, without pair rows.

Ordered pairs of one group are never materialised: with rows in value order, each row knows how
many pairs it takes part in on either side, so pair counts and summed gaps follow from positions.
Pair counts that depend on a second column are in ``ranking``; similarity of entity pairs is in
``similarity``, where batches bound the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import ordering as O


def ordered_pair_summary(df: DataFrame, group: str, value: str, key: str, split_rows: int = O.SPLIT_ROWS) -> DataFrame:
    """Per group: rows, unordered pairs, and the sum of absolute value gaps over all pairs."""
    base = df.select(group, F.col(value).alias("__v"), F.col(key).alias("__k"))
    ordered = O.positions(base, [group], [F.col("__v"), F.col("__k")], "__pos", split_rows)
    n = F.count(F.lit(1))
    return ordered.groupBy(group).agg(
        n.alias("n_rows"),
        F.expr("count(1) * (count(1) - 1) div 2").alias("n_pairs"),
        # the row at position i is the larger one in i-1 pairs and the smaller one in n-i
        (F.sum(F.col("__v") * (2 * F.col("__pos") - 1)) - F.sum("__v") * n).alias("gap_sum"),
    )
