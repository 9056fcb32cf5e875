"""Rank metrics. Pair statistics are exact without ever emitting pairs.

The rows an operator needs are written once; ranks come from running counts over slices
(``ordering``) and pair statistics from slices and buckets of bounded size (``pair_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators import ordering as O
from trialspark.operators.pair_counts import ordered_pair_totals
from trialspark.shared import materialize, null_safe_join

# Fixed values that results depend on.
HINGE_MARGIN, HINGE_GAP, HINGE_MIN_N = 0.5, 0.2, 3
NORM_EPS = 1e-8


def _both_ranks(base: DataFrame, group: list[str], split_rows: int, rows: int | None = None) -> DataFrame:
    if rows is None:
        base, rows = O.counted(base)
    ranked = O.average_ranks(base, group, "__a", "__ra", split_rows, rows)
    return O.average_ranks(ranked, group, "__p", "__rp", split_rows, rows)


def numbered_groups(df: DataFrame, group: str) -> DataFrame:
    """``df`` with a number for each value of ``group`` (also for NULL) in its place, where only the rows' grouping matters; ``df`` should be cheap to read again."""
    numbers = materialize(df.select(group).distinct().withColumn("__number", F.monotonically_increasing_id()))
    return null_safe_join(df, numbers, [group]).withColumn(group, F.col("__number")).drop("__number")


def env_spearman(
    df: DataFrame, group: str | list[str] = "env", actual: str = "actual", pred: str = "pred", split_rows: int = O.SPLIT_ROWS, rows: int | None = None
) -> DataFrame:
    """Per group ``1 − 6Σd²/(n(n²−1))`` over average ranks; NULL below two rows or without spread.

    With ``rows``, their number, ``df`` is cheap to read again and isn't written first (here and below).
    """
    group = [group] if isinstance(group, str) else list(group)
    base = df.select(*group, F.col(actual).alias("__a"), F.col(pred).alias("__p"))
    ranked = _both_ranks(base, group, split_rows, rows)
    d = F.col("__ra") - F.col("__rp")
    m = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(d * d).alias("d2"),
        (F.max("__ra") > F.min("__ra")).alias("__sa"),
        (F.max("__rp") > F.min("__rp")).alias("__sp"),
    )
    n = F.col("n").cast("double")
    rho = F.lit(1.0) - F.try_divide(F.lit(6.0) * F.col("d2"), n * (n * n - 1.0))
    return m.select(*group, "n", F.when((F.col("n") >= 2) & F.col("__sa") & F.col("__sp"), rho).alias("spearman"))


def env_spearman_loss(
    df: DataFrame, group: str = "env", actual: str = "actual", pred: str = "pred", split_rows: int = O.SPLIT_ROWS, rows: int | None = None
) -> DataFrame:
    per = env_spearman(df, group, actual, pred, split_rows, rows)
    return per.agg(
        F.count("spearman").alias("n_envs"), (F.lit(1.0) - F.coalesce(F.avg("spearman"), F.lit(0.0))).alias("loss")
    )


def spearman(df: DataFrame, actual: str = "actual", pred: str = "pred", by: list[str] | None = None, split_rows: int = O.SPLIT_ROWS) -> DataFrame:
    """Pearson of average ranks over all rows (or per ``by``); 0 below two rows."""
    by = by or []
    base = df.select(*by, F.col(actual).alias("__a"), F.col(pred).alias("__p"))
    ranked = _both_ranks(base, by, split_rows)
    m = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx("__rp", "__ra").alias("saa"),
        F.regr_syy("__rp", "__ra").alias("spp"),
        F.regr_sxy("__rp", "__ra").alias("sap"),
    )
    norm = F.greatest(F.sqrt(F.col("saa")) * F.sqrt(F.col("spp")), F.lit(NORM_EPS))
    rho = F.when(F.col("n") >= 2, F.col("sap") / norm).otherwise(F.lit(0.0))
    return m.select(*by, "n", rho.alias("spearman"), (F.lit(1.0) - rho).alias("loss"))


def ktau(
    df: DataFrame,
    group: str | list[str] = "env",
    actual: str = "actual",
    pred: str = "pred",
    key: str = "row_key",
    split_rows: int = O.SPLIT_ROWS,
) -> DataFrame:
    """Concordant minus discordant over their sum: rows in prediction order, ties by key,
    pairs with equal targets ignored."""
    group = [group] if isinstance(group, str) else list(group)
    base = df.select(*group, F.col(actual).alias("__a"), F.col(pred).alias("__p"), F.col(key).alias("__k"))
    m = _concordance(base, group, [F.col("__p"), F.col("__k")], split_rows)
    tau = F.try_divide(F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant"))
    return m.select(*group, "n", "concordant", "discordant", tau.alias("tau"), (F.lit(1.0) - tau).alias("loss"))


def _concordance(base: DataFrame, group: list[str], order: list[Column], split_rows: int) -> DataFrame:
    """Per group: rows, and pairs whose ``__a`` rises or falls along ``order``."""
    base, rows = O.counted(base)
    events = base.withColumns({"v": F.col("__a"), "pt": F.lit(1), "q": F.lit(1)})
    out = ordered_pair_totals(events, rows, group, order, slice_rows=split_rows)
    return out.select(*group, F.col("n_rows").alias("n"), F.col("below").alias("concordant"), F.col("above").alias("discordant"))


def tau_b(
    df: DataFrame,
    group: list[str],
    actual: str = "actual",
    pred: str = "pred",
    key: str = "row_key",
    split_rows: int = O.SPLIT_ROWS,
) -> DataFrame:
    """Kendall's tau with tie correction. Ordering ties of the prediction by the actual value makes
    the falling pairs exactly the discordant ones; tie counts give the rest."""
    base = materialize(df.select(*group, F.col(actual).alias("__a"), F.col(pred).alias("__p"), F.col(key).alias("__k")))
    falls = _concordance(base, group, [F.col("__p"), F.col("__a"), F.col("__k")], split_rows).select(*group, "n", "discordant")
    joint = base.groupBy(*group, "__a", "__p").agg(F.count(F.lit(1)).cast("double").alias("c"))

    def ties(cols: list[str], out: str) -> DataFrame:
        per = joint.groupBy(*group, *cols).agg(F.sum("c").alias("c"))
        return per.groupBy(*group).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(out))

    m = falls
    for cols, out in ((["__a"], "ta"), (["__p"], "tp"), (["__a", "__p"], "tap")):
        m = null_safe_join(m, ties(cols, out), group)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    rises = pairs - F.col("discordant") - F.col("ta") - F.col("tp") + F.col("tap")
    tau = F.try_divide(rises - F.col("discordant"), F.sqrt(pairs - F.col("ta")) * F.sqrt(pairs - F.col("tp")))
    return m.select(*group, "n", tau.alias("tau_b"))


def rank_hinge(
    df: DataFrame,
    env: str = "env",
    actual: str = "actual",
    pred: str = "pred",
    key: str = "row_key",
    margin: float = HINGE_MARGIN,
    gap: float = HINGE_GAP,
    split_rows: int = O.SPLIT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Mean of ``max(0, margin − (p_i − p_j))`` over all pairs of an environment with ``y_j < y_i − gap``.

    Each row enters once as a point ``(y, p)`` and once as a query ``(y − gap, p − margin)``; the
    hinge total of a query is the sum of ``p_j − (p_i − margin)`` over earlier points above it. Pairs
    with a NULL prediction count and add nothing; one with a NaN or infinite prediction makes the mean NaN.
    """
    # equal targets give no pair, so the key's digest only spreads them over slices
    base = df.select(F.col(env).alias("__g"), F.col(actual).cast("double").alias("__a"), F.col(pred).cast("double").alias("__p"), F.xxhash64(key).alias("__k"))
    if rows is None:
        base, rows = O.counted(base)
    both = F.explode(
        F.array(
            F.struct(F.col("__a").alias("t"), F.col("__p").alias("v"), F.lit(1).alias("pt")),
            F.struct((F.col("__a") - gap).alias("t"), (F.col("__p") - margin).alias("v"), F.lit(0).alias("pt")),
        )
    )
    events = base.select("__g", "__k", both.alias("e")).select("__g", "__k", "e.t", "e.v", "e.pt", (1 - F.col("e.pt")).alias("q"))
    order = [F.col("t"), F.col("pt"), F.col("__k")]
    per = ordered_pair_totals(events, 2 * rows, ["__g"], order, weighted=True, slice_rows=split_rows)
    total = F.when(F.col("set_pairs") > F.col("ok_pairs"), F.lit(float("nan"))).otherwise(F.col("gap"))
    usable = per.filter(F.col("n_queries") >= HINGE_MIN_N)
    m = usable.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.sum(total).alias("total"))
    return m.select("n_pairs", F.coalesce(F.try_divide("total", "n_pairs"), F.lit(0.0)).alias("hinge"))


def rank_consistency(
    df: DataFrame,
    hybrid: str = "hybrid",
    actual: str = "actual",
    pred: str = "pred",
    key: str = "row_key",
    split_rows: int = O.SPLIT_ROWS,
) -> DataFrame:
    """Mean over hybrids with two or more rows of ``1 − r`` between ordinal ranks; 0 if none."""
    base = df.select(F.col(hybrid).alias("__g"), F.col(actual).alias("__a"), F.col(pred).alias("__p"), F.col(key).alias("__k"))
    base, rows = O.counted(base)
    ranked = O.positions(base, ["__g"], [F.col("__p"), F.col("__k")], "__rp", split_rows, rows)
    ranked = O.positions(ranked, ["__g"], [F.col("__a"), F.col("__k")], "__ra", split_rows, rows)
    per = ranked.groupBy("__g").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx("__rp", "__ra").alias("saa"),
        F.regr_syy("__rp", "__ra").alias("spp"),
        F.regr_sxy("__rp", "__ra").alias("sap"),
    )
    loss = F.when(F.col("n") >= 2, F.lit(1.0) - F.try_divide("sap", F.sqrt(F.col("saa")) * F.sqrt(F.col("spp"))))
    return per.agg(F.count(loss).alias("n_hybrids"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))
