"""Prediction metrics as grouped aggregations.

Everything starts from ``env_moments``: one partial+final aggregation per group whose rows
(counts, means, centred sums) are enough for every correlation, concordance and error metric,
and can be combined further into the totals over all groups without a second scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import finite, tester_label
from trialspark.schema import TrialError
from trialspark.shared import materialize, null_safe_join

# Fixed values that results depend on.
VAR_EPS = 1e-8
CLOSE_ABS, CLOSE_REL = 1e-8, 1e-5
SELECTION_WEIGHT = 5.0
RANK_TERMS = {"spearman", "envspearman", "ktau", "triplet"}


def finite_pairs(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Rows whose actual and prediction are both finite."""
    return df.filter(finite(actual) & finite(pred))


def clamp(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def _masked(df: DataFrame, actual: str, pred: str, tag: str = "") -> DataFrame:
    """Add the pair as ``__a, __p``, both NULL unless both are finite, so that each row is tested
    once and not in every aggregate."""
    ok = finite(actual) & finite(pred)
    return df.withColumns({f"__a{tag}": F.when(ok, F.col(actual).cast("double")), f"__p{tag}": F.when(ok, F.col(pred).cast("double"))})


def _pair_aggs(spread: bool = False, tag: str = "") -> list[Column]:
    """Aggregates over numbers alone, so that groups are hashed and nothing is sorted."""
    a, p = F.col(f"__a{tag}"), F.col(f"__p{tag}")
    aggs = [
        F.count(a).alias(f"n{tag}"),
        F.avg(a).alias(f"mean_a{tag}"),
        F.avg(p).alias(f"mean_p{tag}"),
        F.regr_sxx(p, a).alias(f"saa{tag}"),
        F.regr_syy(p, a).alias(f"spp{tag}"),
        F.regr_sxy(p, a).alias(f"sap{tag}"),
        F.sum((a - p) * (a - p)).alias(f"sse{tag}"),
    ]
    if spread:
        for side, v in (("a", a), ("p", p)):
            aggs += [F.min(v).alias(f"lo_{side}{tag}"), F.max(v).alias(f"hi_{side}{tag}")]
    return aggs


def env_moments(
    df: DataFrame, group: list[str] | str = "env", actual: str = "actual", pred: str = "pred", spread: bool = False
) -> DataFrame:
    """Per group: n, means, centred sums of squares/products and squared error of finite pairs.

    With ``spread`` also the smallest and largest value of each side.
    """
    group = [group] if isinstance(group, str) else list(group)
    return _masked(df, actual, pred).groupBy(*group).agg(*_pair_aggs(spread))


def combine_moments(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merge per-group moments into totals (law of total variance on the small table)."""
    n, ma, mp = F.col("n"), F.coalesce(F.col("mean_a"), F.lit(0.0)), F.coalesce(F.col("mean_p"), F.lit(0.0))
    total = moments.groupBy(*(by or [])).agg(*_combined_aggs(n, ma, mp))
    return _finish_combined(total)


def _combined_aggs(n: Column, ma: Column, mp: Column) -> list[Column]:
    return [
        F.sum(n).alias("n"),
        F.sum(n * ma).alias("__na"),
        F.sum(n * mp).alias("__np"),
        F.sum("saa").alias("__saa"),
        F.sum("spp").alias("__spp"),
        F.sum("sap").alias("__sap"),
        F.sum(n * ma * ma).alias("__naa"),
        F.sum(n * mp * mp).alias("__npp"),
        F.sum(n * ma * mp).alias("__nap"),
        F.sum("sse").alias("sse"),
    ]


def _finish_combined(total: DataFrame) -> DataFrame:
    n = F.col("n")

    def centred(within: str, raw: str, x: str, y: str) -> Column:
        return F.col(within) + F.col(raw) - F.try_divide(F.col(x) * F.col(y), n)

    return total.withColumns(
        {
            "mean_a": F.try_divide("__na", n),
            "mean_p": F.try_divide("__np", n),
            "saa": centred("__saa", "__naa", "__na", "__na"),
            "spp": centred("__spp", "__npp", "__np", "__np"),
            "sap": centred("__sap", "__nap", "__na", "__np"),
        }
    ).drop("__na", "__np", "__saa", "__spp", "__sap", "__naa", "__npp", "__nap")


def _near(v0: Column) -> Column:
    """How far from the reference value ``v0`` the others may be for a side to count as constant."""
    return F.lit(CLOSE_ABS) + F.lit(CLOSE_REL) * F.abs(v0)


def _flat_by_spread(lo: Column, hi: Column) -> Column:
    """Whether a side is constant as far as its spread can tell; NULL where the reference value decides.

    The reference lies between ``lo`` and ``hi``, so the farthest value is between half the spread and
    the whole spread away from it, and the tolerance is between those at the smallest and largest magnitude.
    """
    spread = hi - lo
    least = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(hi)))
    most = F.greatest(F.abs(lo), F.abs(hi))
    far = spread > F.lit(2.0 + 1e-9) * _near(most)  # the margin covers rounding
    return F.when(spread <= _near(least), F.lit(True)).when(far, F.lit(False))


def _sides(tags: tuple[str, ...]) -> list[str]:
    return [f"{side}{tag}" for tag in tags for side in ("a", "p")]


def _with_flat(moments: DataFrame, pairs: DataFrame, group: list[str], key: str, tags: tuple[str, ...] = ("",)) -> DataFrame:
    """Add ``flat_a, flat_p`` (per tag): all values are close to the one at the smallest key.

    Spreads settle it for nearly all groups. Only groups in the narrow band between, if there are any,
    are looked up in a second scan of ``pairs`` for their reference values. ``moments`` has one
    row per group and is written once.
    """
    sides = _sides(tags)
    known = materialize(moments.withColumns({f"flat_{s}": _flat_by_spread(F.col(f"lo_{s}"), F.col(f"hi_{s}")) for s in sides}))
    open_sides = {s: (F.col(f"n{s[1:]}") >= 2) & F.col(f"flat_{s}").isNull() for s in sides}
    band = known.filter(reduce(lambda x, y: x | y, open_sides.values()))
    if band.isEmpty():
        return known
    if group:
        wanted = band.select(*group).distinct()
        pairs = null_safe_join(pairs, wanted, group, "left_semi")
    for tag in tags:
        own = [f"__a{tag}", f"__p{tag}"]
        rows = pairs.filter(F.col(own[0]).isNotNull() & F.col(key).isNotNull())
        if group:
            first = Window.partitionBy(*group).orderBy(key)  # groups of the band only, cut to one row before the shuffle
            ref = rows.withColumn("__no", F.row_number().over(first)).filter("__no = 1").select(*group, *own)
        else:
            ref = rows.orderBy(key).limit(1).select(*own)
        known = null_safe_join(known, ref, group, "left")
        for side, v in zip(("a", "p"), own, strict=True):
            far = F.greatest(F.col(f"hi_{side}{tag}") - F.col(v), F.col(v) - F.col(f"lo_{side}{tag}"))
            flat = F.coalesce(f"flat_{side}{tag}", far <= _near(F.col(v)))
            known = known.withColumn(f"flat_{side}{tag}", flat)
        known = known.drop(*own)
    return known


def _scored(df: DataFrame, group: list[str], actual: str, pred: str, key: str) -> DataFrame:
    """Moments per group with the constancy of both sides."""
    pairs = _masked(df, actual, pred)
    return _with_flat(pairs.groupBy(*group).agg(*_pair_aggs(True)), pairs, group, key)


def _safe_r(tag: str = "") -> Column:
    c = lambda name: F.col(f"{name}{tag}")
    r = F.try_divide(c("sap"), F.sqrt(c("saa")) * F.sqrt(c("spp")))
    return F.when((c("n") >= 2) & ~(c("flat_a") | c("flat_p")), r)


def _line(tag: str = "") -> tuple[Column, Column]:
    c = lambda name: F.col(f"{name}{tag}")
    slope = F.when((c("n") >= 2) & ~c("flat_a"), F.try_divide(c("sap"), c("saa")))
    return slope, c("mean_p") - slope * c("mean_a")


def safe_pcc(
    df: DataFrame, group: list[str] | str = "env", actual: str = "actual", pred: str = "pred", key: str = "row_key"
) -> DataFrame:
    """Pearson per group; NULL below two pairs or when a side is (nearly) constant."""
    group = [group] if isinstance(group, str) else list(group)
    return _scored(df, group, actual, pred, key).select(*group, "n", _safe_r().alias("pcc"))


def env_pcc(df: DataFrame, min_n: int = 2, group: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Clamped Pearson of every usable group, with its size."""
    return pcc_from_moments(env_moments(df, group, actual, pred), min_n).select(group, "n", "r")


def pcc_from_moments(moments: DataFrame, min_n: int = 2) -> DataFrame:
    usable = (F.col("n") >= min_n) & (F.col("saa") > VAR_EPS) & (F.col("spp") > VAR_EPS)
    r = clamp(F.try_divide("sap", F.sqrt(F.col("saa")) * F.sqrt(F.col("spp"))))
    return moments.withColumn("r", F.when(usable, r))


def macro_env_pcc(df: DataFrame, min_n: int = 2, group: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Plain mean of the per-environment Pearson; the headline score."""
    r = env_pcc(df, min_n, group, actual, pred)
    return r.agg(F.count("r").alias("n_envs"), F.avg("r").alias("macro_pcc"))


def weighted_env_pcc(df: DataFrame, min_n: int = 2, group: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    r = env_pcc(df, min_n, group, actual, pred).filter(F.col("r").isNotNull())
    return r.agg(
        F.sum("n").alias("n_rows"), F.try_divide(F.sum(F.col("r") * F.col("n")), F.sum("n")).alias("weighted_pcc")
    )


def _batch_r() -> Column:
    va = F.greatest(F.col("saa") / F.col("n"), F.lit(VAR_EPS))
    vp = F.greatest(F.col("spp") / F.col("n"), F.lit(VAR_EPS))
    r = clamp((F.col("sap") / F.col("n")) / (F.sqrt(va) * F.sqrt(vp) + F.lit(VAR_EPS)))
    return F.when((va > VAR_EPS) & (vp > VAR_EPS), r)


def _clamped_global_r() -> Column:
    norm = F.sqrt(F.greatest(F.col("saa"), F.lit(VAR_EPS))) * F.sqrt(F.greatest(F.col("spp"), F.lit(VAR_EPS)))
    return clamp(F.col("sap") / norm)


def envpcc_loss(df: DataFrame, min_n: int = 4, group: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """One minus the mean regularised per-environment Pearson; all rows together when no group qualifies."""
    return _envpcc_loss(env_moments(df, group, actual, pred), min_n)


def _envpcc_loss(moments: DataFrame, min_n: int = 4) -> DataFrame:
    rated = moments.withColumn("r", F.when(F.col("n") >= min_n, _batch_r()))
    n, ma, mp = F.col("n"), F.coalesce(F.col("mean_a"), F.lit(0.0)), F.coalesce(F.col("mean_p"), F.lit(0.0))
    total = _finish_combined(rated.agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_envs"), *_combined_aggs(n, ma, mp)))
    fallback = F.coalesce(_clamped_global_r(), F.lit(0.0))
    return total.select("n_envs", (F.lit(1.0) - F.coalesce("mean_r", fallback)).alias("loss"))


def global_pcc(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Pearson over all rows and the matching loss; NULL when a side has no spread."""
    m = _masked(df, actual, pred).agg(*_pair_aggs())
    r = clamp(F.when((F.col("saa") > 0) & (F.col("spp") > 0), F.try_divide("sap", F.sqrt(F.col("saa")) * F.sqrt(F.col("spp")))))
    return m.select("n", r.alias("pcc"), (F.lit(1.0) - _clamped_global_r()).alias("loss"))


def mse(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    m = _masked(df, actual, pred).agg(*_pair_aggs())
    return m.select("n", F.try_divide("sse", "n").alias("mse"))


def macro_env_mse(
    df: DataFrame, min_n: int = 1, fallback: bool = False, group: str = "env", actual: str = "actual", pred: str = "pred"
) -> DataFrame:
    """Mean over groups of the group MSE; optionally the MSE of all rows when none is big enough."""
    return _macro_env_mse(env_moments(df, group, actual, pred), min_n, fallback)


def _macro_env_mse(moments: DataFrame, min_n: int, fallback: bool) -> DataFrame:
    per = F.when(F.col("n") >= max(min_n, 1), F.try_divide("sse", "n"))
    agg = moments.agg(F.count(per).alias("n_envs"), F.avg(per).alias("m"), F.try_divide(F.sum("sse"), F.sum("n")).alias("g"))
    return agg.select("n_envs", (F.coalesce("m", "g") if fallback else F.col("m")).alias("env_mse"))


def envccc_loss(df: DataFrame, group: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """One minus the mean concordance over groups; falls back to the MSE of all rows."""
    return _envccc_loss(env_moments(df, group, actual, pred))


def _envccc_loss(moments: DataFrame) -> DataFrame:
    n = F.col("n")
    va, vp, cov = F.col("saa") / n, F.col("spp") / n, F.col("sap") / n
    shift = F.col("mean_p") - F.col("mean_a")
    ccc = clamp(F.lit(2.0) * cov / (va + vp + shift * shift + F.lit(VAR_EPS)))
    per = F.when(n >= 2, F.when((va > VAR_EPS) & (vp > VAR_EPS), ccc))
    agg = moments.agg(F.count(per).alias("n_envs"), F.avg(per).alias("c"), F.try_divide(F.sum("sse"), F.sum("n")).alias("g"))
    return agg.select("n_envs", F.coalesce(F.lit(1.0) - F.col("c"), F.col("g")).alias("loss"))


def scale_fit(
    df: DataFrame, group: list[str] | str = "env", actual: str = "actual", pred: str = "pred", key: str = "row_key"
) -> DataFrame:
    """Least-squares line of prediction on actual per group."""
    group = [group] if isinstance(group, str) else list(group)
    slope, intercept = _line()
    return _scored(df, group, actual, pred, key).select(*group, "n", slope.alias("slope"), intercept.alias("intercept"))


def split_metrics(
    df: DataFrame,
    group_col: str,
    actual: str = "actual",
    pred: str = "pred",
    rank_pred: str = "rank_pred",
    key: str = "row_key",
) -> DataFrame:
    """Scoreboard per value of ``group_col`` (a NULL group stays a group)."""
    pairs = _masked(_masked(df, actual, pred), actual, rank_pred, "_rank")
    m = _with_flat(pairs.groupBy(group_col).agg(*_pair_aggs(True), *_pair_aggs(True, "_rank")), pairs, [group_col], key, ("", "_rank"))
    slope, intercept = _line()
    rslope, rintercept = _line("_rank")
    return m.select(
        group_col,
        "n",
        _safe_r().alias("pcc"),
        _safe_r("_rank").alias("rank_pcc"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        rslope.alias("rank_slope"),
        rintercept.alias("rank_intercept"),
        F.try_divide("sse", "n").alias("mse"),
    )


def novelty_flag(df: DataFrame, train: DataFrame, hybrid: str = "hybrid") -> DataFrame:
    """Add ``novel_hybrid``: the hybrid never occurs in ``train``."""
    known = train.select(hybrid).distinct().withColumn("__known", F.lit(True))
    flagged = df.join(known, hybrid, "left")
    return flagged.withColumn("novel_hybrid", F.col("__known").isNull()).drop("__known")


def novelty_metrics(df: DataFrame, train: DataFrame, hybrid: str = "hybrid", **kw) -> DataFrame:
    return split_metrics(novelty_flag(df, train, hybrid), "novel_hybrid", **kw)


def tester_metrics(df: DataFrame, tester: str = "parent2", **kw) -> DataFrame:
    """Scoreboard per tester, largest first."""
    board = split_metrics(df.withColumn("tester", tester_label(tester)), "tester", **kw)
    return board.orderBy(F.desc("n"), "tester")


def env_pcc_report(df: DataFrame, group: str = "env", **kw) -> DataFrame:
    """Defined per-environment Pearson values, best first."""
    r = safe_pcc(df, group, **kw).filter(F.col("pcc").isNotNull())
    return r.orderBy(F.desc("pcc"), group)


def run_metrics(
    df: DataFrame,
    env: str = "env",
    actual: str = "actual",
    pred: str = "pred",
    rank_pred: str = "rank_pred",
    key: str = "row_key",
) -> DataFrame:
    """All run-level test metrics in one row from a single scan."""
    pairs = _masked(_masked(df, actual, pred), actual, rank_pred, "_rank")
    per = pcc_from_moments(pairs.groupBy(env).agg(*_pair_aggs(True), *_pair_aggs(True, "_rank")))
    n, ma, mp = F.col("n"), F.coalesce(F.col("mean_a"), F.lit(0.0)), F.coalesce(F.col("mean_p"), F.lit(0.0))
    nr = F.col("n_rank")
    mar, mpr = F.coalesce(F.col("mean_a_rank"), F.lit(0.0)), F.coalesce(F.col("mean_p_rank"), F.lit(0.0))
    bounds = [c for s in _sides(("", "_rank")) for c in (F.min(f"lo_{s}").alias(f"lo_{s}"), F.max(f"hi_{s}").alias(f"hi_{s}"))]
    total = _finish_combined(
        per.agg(
            *_combined_aggs(n, ma, mp),
            *bounds,
            F.avg("r").alias("env_pcc"),
            F.avg(F.try_divide("sse", "n")).alias("env_mse"),
            F.try_divide(F.sum(F.col("r") * n), F.sum(F.when(F.col("r").isNotNull(), n))).alias("env_pcc_weighted"),
            F.sum(nr).alias("n_rank"),
            F.sum(nr * mar).alias("__ra"),
            F.sum(nr * mpr).alias("__rp"),
            (F.sum("saa_rank") + F.sum(nr * mar * mar)).alias("__raa"),
            (F.sum("sap_rank") + F.sum(nr * mar * mpr)).alias("__rap"),
        )
    )
    total = total.withColumns(
        {
            "mean_a_rank": F.try_divide("__ra", "n_rank"),
            "mean_p_rank": F.try_divide("__rp", "n_rank"),
            "saa_rank": F.col("__raa") - F.try_divide(F.col("__ra") * F.col("__ra"), F.col("n_rank")),
            "sap_rank": F.col("__rap") - F.try_divide(F.col("__ra") * F.col("__rp"), F.col("n_rank")),
        }
    )
    total = _with_flat(total, pairs, [], key, ("", "_rank"))
    slope, intercept = _line()
    rslope, rintercept = _line("_rank")
    return total.select(
        "n",
        _safe_r().alias("global_pcc"),
        F.try_divide("sse", "n").alias("global_mse"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        rslope.alias("rank_slope"),
        rintercept.alias("rank_intercept"),
        "env_pcc",
        "env_mse",
        "env_pcc_weighted",
    )


def env_level_pcc(df: DataFrame, target: str, pred: str, env: str = "env", min_envs: int = 3) -> DataFrame:
    """Mean prediction per environment against that environment's own constant target."""
    per = df.groupBy(env).agg(F.avg(pred).alias("p"), F.avg(target).alias("t"))
    m = per.agg(
        F.count(F.lit(1)).alias("n_envs"),
        F.regr_sxx("p", "t").alias("stt"),
        F.regr_syy("p", "t").alias("spp"),
        F.regr_sxy("p", "t").alias("stp"),
    )
    r = F.when((F.col("stt") > 0) & (F.col("spp") > 0), F.try_divide("stp", F.sqrt(F.col("stt")) * F.sqrt(F.col("spp"))))
    return m.select("n_envs", F.when(F.col("n_envs") >= min_envs, r).alias("env_level_pcc"))


def masked_mse(df: DataFrame, flag: str, mode: str = "mse", **kw) -> DataFrame:
    """MSE (or macro environment MSE) over the rows whose flag is true."""
    kept = df.filter(F.col(flag))
    if mode == "mse":
        return mse(kept, **kw)
    if mode == "envmse":
        return macro_env_mse(kept, min_n=2, fallback=True, **kw)
    raise TrialError(f"unknown mode: {mode}")


def selection_metric(df: DataFrame, mode: str = "pcc", w: float = SELECTION_WEIGHT, mse_col: str = "mse", corr_col: str = "pcc") -> DataFrame:
    """Add ``score`` with ``higher_is_better``: the correlation itself, or ``mse − w·corr``."""
    if mode == "pcc":
        return df.withColumns({"score": F.col(corr_col), "higher_is_better": F.lit(True)})
    if mode == "mse_corr":
        score = F.col(mse_col) - F.lit(float(w)) * F.coalesce(F.col(corr_col), F.lit(0.0))
        return df.withColumns({"score": score, "higher_is_better": F.lit(False)})
    raise TrialError(f"unknown selection mode: {mode}")


def huber(df: DataFrame, actual: str = "actual", pred: str = "pred", beta: float = 1.0) -> DataFrame:
    """Mean smooth-L1 error."""
    d = F.abs(F.col(pred) - F.col(actual))
    loss = F.when(d < beta, F.lit(0.5) * d * d / beta).otherwise(d - 0.5 * beta)
    return finite_pairs(df, actual, pred).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("huber"))


def residual_part_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One MSE column per named (actual, prediction) pair, from one aggregation."""
    aggs = []
    for name, (a, p) in pairs.items():
        d = F.col(a) - F.col(p)
        aggs.append(F.avg(F.when(finite(a) & finite(p), d * d)).alias(f"mse_{name}"))
    return df.agg(*aggs)


def _one_value(df: DataFrame, term: str, col: str) -> DataFrame:
    return df.select(F.lit(term).alias("term"), F.col(col).cast("double").alias("value"))


def composite_score(
    df: DataFrame,
    spec: str,
    weights: str | None = None,
    env: str = "env",
    actual: str = "actual",
    pred: str = "pred",
    key: str = "row_key",
) -> DataFrame:
    """Weighted sum of named terms, e.g. ``"mse+envpcc"`` with ``"1,0.5"``.

    One row per term plus a ``total`` row. Moment-based terms share one aggregated table.
    """
    from trialspark.operators import ranking as R

    terms = [t.strip().lower() for t in spec.split("+")]
    ws = [1.0] * len(terms) if weights is None else [float(w) for w in weights.split(",")]
    if len(ws) != len(terms):
        raise TrialError(f"{len(ws)} weights given for {len(terms)} terms")
    df = finite_pairs(df, actual, pred)
    rows, grouped = None, df
    if RANK_TERMS & set(terms):  # several scans follow
        df = materialize(df.select(*dict.fromkeys([env, actual, pred, key])))
        rows = df.count()
        grouped = R.numbered_groups(df, env) if {"envspearman", "triplet"} & set(terms) else df
    moments = env_moments(df, env, actual, pred)
    total = combine_moments(moments)
    registry = {
        "mse": lambda: (total.withColumn("v", F.try_divide("sse", "n")), "v"),
        "pcc": lambda: (total.withColumn("v", F.lit(1.0) - _clamped_global_r()), "v"),
        "envmse": lambda: (_macro_env_mse(moments, 2, True), "env_mse"),
        "envccc": lambda: (_envccc_loss(moments), "loss"),
        "envpcc": lambda: (_envpcc_loss(moments), "loss"),
        "spearman": lambda: (R.spearman(df, actual, pred), "loss"),
        "envspearman": lambda: (R.env_spearman_loss(grouped, env, actual, pred, rows=rows), "loss"),
        "ktau": lambda: (R.ktau(df, [], actual, pred, key), "loss"),
        "triplet": lambda: (R.rank_hinge(grouped, env, actual, pred, key, rows=rows), "hinge"),
    }
    parts = []
    for term, w in zip(terms, ws):
        if term not in registry:
            raise TrialError(f"unknown or unimplemented term: {term}")
        one, col = registry[term]()
        parts.append(_one_value(one, term, col).withColumn("weight", F.lit(w)))
    long = reduce(DataFrame.unionByName, parts)
    rolled = long.rollup("term").agg(
        F.sum("weight").alias("weight"), F.sum("value").alias("value"), F.sum(F.col("weight") * F.col("value")).alias("weighted")
    )
    return rolled.select(F.coalesce("term", F.lit("total")).alias("term"), "weight", "value", "weighted")
