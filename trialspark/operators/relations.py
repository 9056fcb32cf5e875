"""Filters, role projection, set operations, key joins and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import env_year_lenient
from trialspark.schema import TrialError, TrialSchema, require_columns


# -- filters and projections -------------------------------------------------------------

def filter_years(df: DataFrame, lo: int | None = None, hi: int | None = None, env: str = "env") -> DataFrame:
    """Rows whose lenient year lies in [lo, hi]; no bound at all keeps everything."""
    if lo is None and hi is None:
        return df
    year = env_year_lenient(env)
    if lo is None or hi is None:
        inside = year >= lo if hi is None else year <= hi
    else:  # both bounds in one comparison, as a filter works out a name's year anew wherever it occurs
        inside = F.abs(year.cast("long") * 2 - (lo + hi)) <= hi - lo
    return df.filter(F.coalesce(inside, F.lit(False)))


def feature_view(df: DataFrame, schema: TrialSchema, with_keys: bool = True) -> DataFrame:
    """Only the feature columns, chosen by role; keys in front when asked for."""
    require_columns(df, schema.features, "feature table")
    keys = [schema.id, schema.env] if with_keys else []
    return df.select(*keys, *schema.features)


def in_set(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in ``keys`` (semi join on all columns of ``keys``)."""
    return df.join(keys, keys.columns, "left_semi")


def not_in_set(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti")


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with NULLs and how many, from one aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns]))
    return counts.select(pairs.alias("p")).select("p.column", "p.n_null").filter("n_null > 0")


# -- set operations ----------------------------------------------------------------------

def novel_keys(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Distinct keys of ``a`` that never occur in ``b``."""
    key = [key] if isinstance(key, str) else key
    return a.select(*key).subtract(b.select(*key))


def shared_keys(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    return a.select(*key).intersect(b.select(*key))


def all_parents(df: DataFrame) -> DataFrame:
    """Distinct names occurring as either parent; the empty name is not a parent."""
    both = df.select(F.explode(F.array("parent1", "parent2")).alias("parent"))
    return both.filter(F.col("parent") != "").distinct()


def union_results(dfs: list[DataFrame]) -> DataFrame:
    if not dfs:
        raise TrialError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), dfs)


# -- joins -------------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def attach_target(x: DataFrame, y: DataFrame, how: str = "inner", on: str = "id", check_unique: bool = True) -> DataFrame:
    """Features joined with targets on the key; repeated target keys are an error, not a fan-out."""
    if how not in ("inner", "left"):
        raise TrialError(f"unsupported join: {how}")
    if check_unique and not duplicate_keys(y, [on]).isEmpty():
        raise TrialError(f"target table repeats values of {on}")
    return x.join(y, on, how)


def align_pairs(x: DataFrame, y: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Restrict both tables to their common keys and report where they disagree.

    The report has one row per status: keys and rows found on both sides, only in x, only in y,
    and keys whose row counts differ.
    """
    keys = keys or ["env", "hybrid"]
    nx = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("nx"))
    ny = y.groupBy(*keys).agg(F.count(F.lit(1)).alias("ny"))
    both = nx.join(ny, keys, "full_outer")
    status = (
        F.when(F.col("ny").isNull(), "only_x")
        .when(F.col("nx").isNull(), "only_y")
        .when(F.col("nx") != F.col("ny"), "row_count_differs")
        .otherwise("aligned")
    )
    zero = F.lit(0)
    report = both.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.coalesce("nx", zero)).alias("rows_x"),
        F.sum(F.coalesce("ny", zero)).alias("rows_y"),
    )
    return in_set(x, ny.select(*keys)), in_set(y, nx.select(*keys)), report


def compare_submissions(named: dict[str, DataFrame], keys: list[str] | None = None, value: str = "pred") -> DataFrame:
    """Inner join of prediction sets, then correlation and line of best fit for each pair."""
    keys = keys or ["env", "hybrid"]
    names = list(named)
    if len(names) < 2:
        raise TrialError("need at least two submissions")
    sides = [df.select(*keys, F.col(value).cast("double").alias(f"v_{n}")) for n, df in named.items()]
    wide = reduce(lambda a, b: a.join(b, keys), sides)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    stats = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"v_{b}", f"v_{a}").alias(f"{t}_{a}_{b}") for a, b in pairs for t, f in (("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))],
        *[F.avg(f"v_{n}").alias(f"mean_{n}") for n in names],
    )
    rows = []
    for a, b in pairs:
        sxx, syy, sxy = (F.col(f"{t}_{a}_{b}") for t in ("sxx", "syy", "sxy"))
        slope = F.try_divide(sxy, sxx)
        r = F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))
        rows.append(
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                F.col("n"),
                r.alias("pcc"),
                slope.alias("slope"),
                (F.col(f"mean_{b}") - slope * F.col(f"mean_{a}")).alias("intercept"),
            )
        )
    return stats.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)
