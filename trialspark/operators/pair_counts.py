"""Totals over ordered pairs of a group, without pair rows and without a whole group in one task.

Rows are range-partitioned twice: by their order into slices, and by their value into buckets. Pairs
inside a slice and pairs inside a bucket are counted by tasks that hold one slice or bucket of bounded
size; a pair in different slices and different buckets is decided by where its cells lie, so the grid of
cell totals is enough. Only groups that lie in more than one slice go through the second partitioning,
so each row is shuffled twice at most, whatever the size of its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.shared import materialize, null_safe_join

SLICE_ROWS = 1 << 16
COUNTS = ["n_points", "n_queries", "set_points", "set_queries", "ok_points", "ok_queries"]
RELATIONS = ["below", "above"]


def slices_for(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    """Slices of about ``slice_rows`` rows, but never more than the square root of the rows, so that
    the grid of slices and buckets stays below the rows themselves."""
    return max(1, min(-(-rows // slice_rows), math.isqrt(max(rows, 1)) + 1))


def pair_totals(group: np.ndarray, rank: np.ndarray, value: np.ndarray, point: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group, over pairs of a point and a later query: ranks below, ranks above, and value gaps above.

    Rows come in order, those of a group adjacent, and groups are numbered from 0. Bit by bit of the
    rank, rows that share all higher bits lie side by side in their order, and running counts of
    set and unset bits say how many earlier points differ in this bit; each level is a few vector
    operations, and a stable split by the bit makes the next one.
    """
    n, groups = len(group), int(group[-1]) + 1 if len(group) else 0
    below, above, gap = np.zeros(groups), np.zeros(groups), np.zeros(groups)
    at, valued = np.arange(n), bool(value.any())
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    start = first[group] if n else at
    end = np.append(first[1:], n)[group] if n else at

    def before(x: np.ndarray) -> np.ndarray:
        """Sum of ``x`` over earlier rows of the same node."""
        total = running(x)
        return total[:-1] - total[start]

    def running(x: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64 if x.dtype == bool else x.dtype)
        np.cumsum(x, out=total[1:])
        return total

    def per_group(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first)

    for bit in reversed(range(int(rank.max()).bit_length() if n else 0)):
        one = (rank >> bit) & 1 == 1
        high = point & one
        low_before, high_before = before(point & ~one), before(high)
        down = asked & ~one
        below += per_group(low_before * (asked & one))
        above += per_group(high_before * down)
        if valued:
            weight = before(np.where(high, value, 0.0)) - value * high_before
            gap += per_group(np.where(down, weight, 0.0))
        if not bit:
            break
        set_bits = running(one)
        ones = set_bits[:-1] - set_bits[start]
        split = end - (set_bits[end] - set_bits[start])
        to = np.where(one, split + ones, at - ones)
        back = np.empty(n, np.int64)
        back[to] = at
        rank, value, point, asked = (x[back] for x in (rank, value, point, asked))
        lower = at < split  # a node's bounds and group belong to its places, whichever rows take them
        start, end = np.where(lower, start, split), np.where(lower, split, end)
    return below, above, gap


def _adjacent_codes(columns: list[pa.ChunkedArray], n: int) -> np.ndarray:
    """Numbers from 0 for runs of equal rows; NULLs are equal to each other."""
    change = np.zeros(n, bool)
    for c in columns:
        codes = pc.dictionary_encode(c.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of one slice or bucket, whose number is bounded by the range partitioning."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


class _Rows:
    """The columns of one slice or bucket, with group codes, ranks and the classes of values.

    ``set`` are values that aren't NULL and ``ok`` those that are compared: all of them when only
    their order matters (NULL lowest, NaN highest), the finite ones when their gaps are summed.
    """

    def __init__(self, table: pa.Table, groups: int, weighted: bool):
        n = table.num_rows
        self.keys = [table.column(i).combine_chunks() for i in range(groups)]
        self.group = _adjacent_codes(table.columns[:groups], n)
        v = table.column("v").combine_chunks()
        null = v.is_null().to_numpy(zero_copy_only=False)
        raw = v.fill_null(0).to_numpy(zero_copy_only=False)
        self.rank = np.where(null, 0, np.unique(raw, return_inverse=True)[1] + 1)
        self.point, self.asked = (table.column(c).to_numpy().astype(bool) for c in ("pt", "q"))
        self.set = ~null
        self.ok = self.set & np.isfinite(raw) if weighted else np.ones(n, bool)
        self.value = np.where(self.ok, raw, 0).astype(np.float64) if weighted else np.zeros(n)

    def related(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pair_totals(codes, self.rank, self.value, self.point & self.ok, self.asked & self.ok)


def _slice_pass(groups: int, weighted: bool, schema: pa.Schema):
    """Counts inside a slice per group; rows of the first and last group go on, as only those can continue elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        rows = _Rows(table, groups, weighted)
        below, above, gap = rows.related(rows.group)
        total = len(below)
        masks = [rows.point, rows.asked, rows.point & rows.set, rows.asked & rows.set, rows.point & rows.ok, rows.asked & rows.ok]
        first = _starts(rows.group)
        inside = []
        for p, q in zip(masks[::2], masks[1::2], strict=True):
            earlier = np.concatenate([[0], np.cumsum(p)])
            inside.append(np.bincount(rows.group, q * (earlier[:-1] - earlier[first[rows.group]]), total))
        per = [np.bincount(rows.group, m, total) for m in masks]
        fields = [pa.array(x.astype(np.int64)) for x in [*per, *inside, below, above]] + [pa.array(gap), pa.array(np.bincount(rows.group, minlength=total).astype(np.int64))]
        totals = pa.StructArray.from_arrays(fields, fields=list(schema.field("totals").type))
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [*[k.take(at) for k in rows.keys], table.column("slice").combine_chunks().take(at), *[pa.nulls(total, schema.field(c).type) for c in ("pos", "v", "pt", "q")], totals], schema=schema
        )
        edge = table.filter(pa.array((rows.group == 0) | (rows.group == total - 1)))
        out = edge.append_column(schema.field("totals"), pa.nulls(edge.num_rows, schema.field("totals").type))
        yield from out.cast(schema).combine_chunks().to_batches()

    return run


def _bucket_pass(groups: int, weighted: bool, schema: pa.Schema):
    """Pairs of a bucket in different slices, and totals of its cells (``kind`` cell), and of the cells of
    its first and last value (``kind`` tie), which may go on in the neighbouring buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        rows = _Rows(table, groups, weighted)
        cell = _adjacent_codes([*table.columns[:groups], table.column("slice")], table.num_rows)
        every, same = rows.related(rows.group), rows.related(cell)
        owner = rows.group[_starts(cell)]
        apart = [a - np.bincount(owner, s, len(a)) for a, s in zip(every, same, strict=True)]
        point, asked = rows.point & rows.ok, rows.asked & rows.ok

        def emit(kind: str, chosen: np.ndarray, codes: np.ndarray, pairs: list[np.ndarray] | None = None) -> pa.RecordBatch:
            """Totals of the chosen rows per code; their codes are adjacent."""
            codes = np.cumsum(np.concatenate([[0], np.diff(codes[chosen]) != 0]))
            first, size = chosen[_starts(codes)], int(codes[-1]) + 1
            at = pa.array(first)
            counts = [np.bincount(codes, m[chosen], size).astype(np.int64) for m in (point, asked)]
            values = [np.bincount(codes, (rows.value * m)[chosen], size) for m in (point, asked)]
            place = [table.column(c).combine_chunks().take(at) for c in ("slice", "bucket")]
            v = table.column("v").combine_chunks()
            none = pa.nulls(size, pa.float64())
            extra = [none] * 3 if pairs is None else [pa.array(x) for x in pairs]
            arrays = [*[k.take(at) for k in rows.keys], pa.array([kind] * size), *place, v.take(at) if kind == "tie" else pa.nulls(size, v.type)]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(x) for x in (*counts, *values)], *extra], schema=schema)

        whole = np.arange(table.num_rows)
        yield emit("group", whole, rows.group, apart)
        yield emit("cell", whole, cell)
        size = int(rows.group[-1]) + 1
        low, high = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        np.minimum.at(low, rows.group, rows.rank)
        np.maximum.at(high, rows.group, rows.rank)
        yield emit("tie", np.flatnonzero(rows.rank == low[rows.group]), cell)
        last = np.flatnonzero((rows.rank == high[rows.group]) & (low != high)[rows.group])  # a bucket of one value is reported once
        if len(last):
            yield emit("tie", last, cell)

    return run


def _related(totals: DataFrame, group: list[str]) -> DataFrame:
    return totals.select(*group, *[F.col(c).cast("long").alias(c) for c in RELATIONS], "gap")


def _earlier_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: totals over pairs of cells, the point's in an earlier slice and another bucket.

    Cells are filled up to a grid; running sums over slices and then over buckets say what lies before
    each cell and below or above it.
    """
    spans = cells.groupBy(*keys).agg(F.min("bucket").alias("__lo"), F.max("bucket").alias("__hi"))
    lines = null_safe_join(cells.select(*keys, "slice").distinct(), spans, keys)
    grid = lines.select(*keys, "slice", F.explode(F.sequence("__lo", "__hi")).alias("bucket"))
    sums = ["points", "queries", "point_sum", "query_sum"]
    filled = null_safe_join(grid, cells.groupBy(*keys, "slice", "bucket").agg(*[F.sum(c).alias(c) for c in sums]), [*keys, "slice", "bucket"], "left").fillna(0, sums)
    start = Window.unboundedPreceding
    earlier = Window.partitionBy(*keys, "bucket").orderBy("slice").rowsBetween(start, -1)
    run = filled.withColumns({"__n": F.coalesce(F.sum("points").over(earlier), F.lit(0)), "__s": F.coalesce(F.sum("point_sum").over(earlier), F.lit(0.0))})
    lower = Window.partitionBy(*keys, "slice").orderBy("bucket").rowsBetween(start, -1)
    upper = Window.partitionBy(*keys, "slice").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    placed = run.withColumns({"__low": F.sum("__n").over(lower), "__high": F.sum("__n").over(upper), "__high_sum": F.sum("__s").over(upper)})
    return placed.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("queries") * F.col("__low")), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.col("queries") * F.col("__high")), F.lit(0)).alias("above"),
        F.coalesce(F.sum(F.col("queries") * F.col("__high_sum") - F.col("query_sum") * F.col("__high")), F.lit(0.0)).alias("gap"),
    )


def ordered_pair_totals(events: DataFrame, rows: int, group: list[str], order: list[Column], weighted: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per group, totals over pairs of a point and a query that comes later in ``order``.

    ``events`` has the group columns, what ``order`` names, ``v`` (the value, a long or a double), ``pt``
    and ``q`` (1 for points and for queries, else 0); ``rows`` is an upper bound on its rows, and
    ``order`` should be total. Result: the group columns and ``n_rows``, ``n_points``, ``n_queries``,
    ``pairs``, ``set_pairs`` (both values set), ``ok_pairs`` (both compared), ``below``, ``above`` (the
    point's value is below or above the query's) and ``gap`` (sum of point less query over the latter).
    NULL is a group of its own and the lowest value, NaN the highest; with ``weighted`` neither they
    nor infinite values are compared.
    """
    slices = slices_for(rows, slice_rows)
    ranged = events.repartitionByRange(slices, *group, *order) if slices > 1 else events.repartition(1)
    placed = ranged.sortWithinPartitions(*group, *order).select(
        *group, F.spark_partition_id().cast("long").alias("slice"), F.monotonically_increasing_id().alias("pos"), "v", F.col("pt").cast("int").alias("pt"), F.col("q").cast("int").alias("q")
    )
    inner = ["pairs", "set_pairs", "ok_pairs", *RELATIONS]
    total_type = ",".join(f"{c}:bigint" for c in [*COUNTS, *inner]) + ",gap:double,n_rows:bigint"
    empty = placed.withColumn("totals", F.lit(None).cast(f"struct<{total_type}>"))
    schema = _nullable(empty)
    stored = materialize(placed.mapInArrow(_slice_pass(len(group), weighted, _arrow(schema)), schema))
    totals = stored.filter("totals is not null").select(*group, "slice", "totals.*")
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n_rows": F.sum("n_rows")} | {c: F.sum(c) for c in [*COUNTS[:2], "gap", *RELATIONS]}
    for out, kind in (("pairs", "n"), ("set_pairs", "set"), ("ok_pairs", "ok")):
        totals = totals.withColumn(out, F.col(out) + F.col(f"{kind}_queries") * F.coalesce(F.sum(f"{kind}_points").over(earlier), F.lit(0)))
        sums[out] = F.sum(out)
    base = totals.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()])
    if slices == 1:
        return base

    wide = totals.groupBy(*group).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").drop("__k")
    loose = stored.filter("totals is null").drop("totals")
    if group:
        loose = null_safe_join(loose, wide, group, "left_semi")
    loose = materialize(loose)
    buckets = slices_for(loose.count(), slice_rows)
    dealt = loose.repartitionByRange(buckets, *group, "v", "pos") if buckets > 1 else loose.repartition(1)
    sorted_rows = dealt.withColumn("bucket", F.spark_partition_id().cast("long")).sortWithinPartitions(*group, "pos")
    vt = dict(loose.dtypes)["v"]
    numbers = [F.lit(0).cast("long").alias(c) for c in ("points", "queries")] + [F.lit(0.0).alias(c) for c in ("point_sum", "query_sum", *RELATIONS, "gap")]
    out = _nullable(loose.select(*group, F.lit("").alias("kind"), "slice", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast(vt).alias("v"), *numbers))
    counted = materialize(sorted_rows.mapInArrow(_bucket_pass(len(group), weighted, _arrow(out)), out))
    within = counted.filter("kind = 'group'").groupBy(*group).agg(*[F.sum(c).alias(c) for c in (*RELATIONS, "gap")])
    across = _earlier_cells(counted.filter("kind = 'cell'"), group)
    # equal values that fill several buckets stand in them in order, so the grid took them for rising pairs
    ties = _earlier_cells(counted.filter("kind = 'tie'"), [*group, "v"]).select(*group, (-F.col("below")).alias("below"), F.lit(0).alias("above"), F.lit(0.0).alias("gap"))
    merged = reduce(DataFrame.unionByName, [_related(p, group) for p in (base, within, across, ties)])
    related = merged.groupBy(*group).agg(*[F.sum(c).alias(c) for c in (*RELATIONS, "gap")])
    return null_safe_join(base.drop(*RELATIONS, "gap"), related, group)


def _nullable(df: DataFrame):
    schema = df.schema
    for f in schema.fields:
        f.nullable = True
    return schema


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
