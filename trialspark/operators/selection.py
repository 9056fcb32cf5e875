"""Fold and configuration selection, cross-validation summaries and the rolling harness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import expressions as X
from trialspark.functions.expressions import finite
from trialspark.operators import effects as E
from trialspark.operators import metrics as M
from trialspark.operators import ranking as R
from trialspark.operators.features import MARKER_STD_MIN
from trialspark.operators.sequences import best_fold, latest_fold
from trialspark.schema import TrialError
from trialspark.shared import materialize

# Fixed values that results depend on.
NO_EVAL = ["", "none", "off", "false", "0", "no"]
BOTH_MODES = ["best_and_latest", "best+latest", "both"]
STRONG, MODERATE = 0.8, 0.5
SPREAD_MIN = 1e-12  # below this share of its mean a standard deviation is rounding
RANK_DELTA, RANK_BAR, SCALE_TOLERANCE, RANK_SEEDS = 0.003, 0.43, 0.002, 3


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std of the best loss and PCC, with the best and the latest fold."""
    stats = folds.agg(
        F.avg("best_val_loss").alias("mean_val_loss"),
        F.stddev_pop("best_val_loss").alias("std_val_loss"),
        F.avg("best_val_env_avg_pearson").alias("mean_val_pcc"),
        F.stddev_pop("best_val_env_avg_pearson").alias("std_val_pcc"),
    )
    b = best_fold(folds).select(F.col("val_year").alias("best_fold_year"), F.col("best_val_env_avg_pearson").alias("best_fold_pcc"), F.col("best_checkpoint").alias("best_fold_checkpoint"))
    last = latest_fold(folds).select(F.col("val_year").alias("latest_fold_year"), F.col("best_checkpoint").alias("latest_fold_checkpoint"))
    return stats.join(F.broadcast(b)).join(F.broadcast(last))  # one row each


def select_eval(folds: DataFrame, mode: str) -> DataFrame:
    """Fold records to evaluate, tagged in order; a checkpoint is taken once, missing ones never."""
    mode = mode.strip().lower()
    best = lambda: best_fold(folds).withColumns({"tag": F.lit("best_fold"), "tag_order": F.lit(0)})
    last = lambda: latest_fold(folds).withColumns({"tag": F.lit("latest_fold"), "tag_order": F.lit(1)})
    tagged = folds.withColumns({"tag": F.concat(F.lit("fold_"), F.col("val_year").cast("string")), "tag_order": F.col("val_year").cast("int")})
    if mode in NO_EVAL:
        picks = tagged.limit(0)
    elif mode == "best_fold":
        picks = best()
    elif mode == "latest_fold":
        picks = last()
    elif mode in BOTH_MODES:
        picks = best().unionByName(last())
    elif mode == "all_folds":
        picks = tagged
    elif mode.startswith("year:"):
        year = int(mode.split(":", 1)[1].strip())
        same = folds.filter(F.col("val_year") == year)
        one = same.agg(F.min_by(F.struct(*folds.columns), "fold_idx").alias("r")).filter("r is not null").select("r.*")
        picks = one.withColumns({"tag": F.lit(f"fold_{year}"), "tag_order": F.lit(0)})
    else:
        raise TrialError(f"unknown evaluation mode: {mode}")
    usable = picks.filter((F.col("best_checkpoint") != "") & F.col("best_checkpoint").isNotNull())
    w = Window.partitionBy("best_checkpoint").orderBy("tag_order", "fold_idx")  # a few folds
    return usable.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def primary_metrics(evals: DataFrame, tag: str) -> DataFrame:
    """The evaluation under the requested tag, else ``best_fold``, else the first one."""
    rank = F.when(F.col("tag") == tag, 0).when(F.col("tag") == "best_fold", 1).otherwise(2)
    picked = evals.agg(F.min_by(F.struct(*evals.columns), F.struct(rank, F.col("tag_order"), F.col("tag"))).alias("r"))
    return picked.filter("r is not null").select("r.*")


def fold_seed_summary(df: DataFrame, value: str = "val_env_pcc", fold: str = "val_year") -> DataFrame:
    """Mean, sample std (0 for one record) and count, overall (NULL fold) and per fold."""
    out = df.rollup(fold).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
    return out


def _long(df: DataFrame, selectors: list[str], test: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("selector"), F.col(s).cast("double").alias("score")) for s in selectors]))
    return df.select(pairs.alias("p"), F.col(test).cast("double").alias("test")).select("p.selector", "p.score", "test")


def selector_tracking(runs: DataFrame, selectors: tuple[str, str] = ("lygo_pcc", "leo_pcc"), test: str = "test_pcc") -> DataFrame:
    """Spearman of each selector's finite scores with the test score; does the first beat the second."""
    a, b = selectors
    rho = R.spearman(M.finite_pairs(_long(runs, [a, b], test), "test", "score"), "test", "score", by=["selector"])
    pick = lambda s: F.max(F.when(F.col("selector") == s, F.col("spearman")))
    out = rho.agg(pick(a).alias(a), pick(b).alias(b), F.max("n").alias("n_runs"))
    return out.withColumn("first_beats_second", F.col(a) > F.col(b))


def cv_test_correlation(runs: DataFrame, cv: str = "cv_val_pcc", test: str = "test_pcc", key: str = "run_id") -> DataFrame:
    """Spearman, Kendall (tau-b) and Pearson between CV and test scores with a verdict.

    Fewer than three finite pairs give NULLs and an insufficient verdict.
    """
    ok = M.finite_pairs(runs, cv, test).select(F.lit("all").alias("g"), F.col(cv).alias("x"), F.col(test).alias("y"), F.col(key).alias("k"))
    rho = R.spearman(ok, "x", "y", by=["g"]).select("g", F.col("n"), "spearman")
    r = M.safe_pcc(ok, "g", "x", "y", "k").select("g", F.col("pcc").alias("pearson"))
    tau = R.tau_b(ok, ["g"], "x", "y", "k").select("g", F.col("tau_b").alias("kendall"))
    joined = rho.join(r, "g").join(tau, "g")
    totals = ok.groupBy().agg(F.count(F.lit(1)).alias("n_pairs")).withColumn("g", F.lit("all"))
    out = totals.join(joined, "g", "left")
    enough = F.col("n_pairs") >= 3
    s = F.when(enough, F.col("spearman"))
    verdict = F.when(s.isNull(), "INSUFFICIENT").when(s >= STRONG, "STRONG").when(s >= MODERATE, "MODERATE").otherwise("WEAK")
    return out.select("n_pairs", s.alias("spearman"), F.when(enough, F.col("kendall")).alias("kendall"), F.when(enough, F.col("pearson")).alias("pearson"), verdict.alias("verdict"))


def promotion(runs: DataFrame, baseline_pcc: Column | float, baseline_scale_mse: Column | float, baseline_scale_pcc: Column | float) -> DataFrame:
    """Promotion decisions per configuration from per-seed rows ``(config, env_pcc, env_mse)``.

    Rank: the mean of at least three seeds gains the required margin, or a single run passes the
    bar and another run of the configuration supports it. A baseline may be a column of ``runs`` that is
    the same in every row. Scale: error improves and correlation
    loses no more than the tolerance.
    """
    given = {"pcc": baseline_pcc, "scale_mse": baseline_scale_mse, "scale_pcc": baseline_scale_pcc}
    of = {k: F.col(f"__{k}") for k in given}
    m = runs.groupBy("config").agg(
        *[F.max(v if isinstance(v, Column) else F.lit(float(v))).alias(f"__{k}") for k, v in given.items()],
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("env_pcc").alias("mean_pcc"),
        F.count_if(F.col("env_pcc") > RANK_BAR).alias("n_above_bar"),
        F.avg("env_mse").alias("mean_mse"),
    )
    by_mean = (F.col("n_runs") >= RANK_SEEDS) & (F.col("mean_pcc") >= of["pcc"] + F.lit(RANK_DELTA))
    by_bar = F.col("n_above_bar") >= 2
    scale = (F.col("mean_mse") < of["scale_mse"]) & (of["scale_pcc"] - F.col("mean_pcc") <= F.lit(SCALE_TOLERANCE))
    return m.withColumns({"promote_rank": by_mean | by_bar, "promote_scale": scale}).drop("__pcc", "__scale_mse", "__scale_pcc")


# -- rolling harness ---------------------------------------------------------------------

Fit = Callable[[DataFrame], object]
Predict = Callable[[DataFrame, object], DataFrame]


def _fold_scores(scored: DataFrame, target: str, by: list[str]) -> DataFrame:
    m = M.pcc_from_moments(M.env_moments(scored, [*by, "env"], target, "pred"))
    return m.groupBy(*by).agg(
        F.sum("n").alias("n_val"),
        F.avg("r").alias("env_pcc"),
        F.avg(F.when(F.col("n") >= 2, F.try_divide("sse", "n"))).alias("env_mse"),
        F.try_divide(F.sum("sse"), F.sum("n")).alias("mse"),
    )


def rolling_fit_predict(df: DataFrame, folds: DataFrame, target: str = "yield_mg", fit: Fit | None = None, predict: Predict | None = None) -> DataFrame:
    """Per fold: fit on its training years, predict its validation year, score.

    Without callbacks the additive decomposition is fitted for all folds in one job: plots are
    summed per (year, environment, hybrid) once, and only those sums are repeated per fold. With
    callbacks every fold is its own job, and only its scores are kept.
    """
    keys = ["fold_idx", "train_year_max", "val_year"]
    if (fit is None) != (predict is None):
        raise TrialError("give both fit and predict, or neither")
    if fit is None:
        usable = df.filter(finite(target))
        cells = usable.groupBy("year", "env", "hybrid").agg(F.sum(target).alias("s"), F.count(F.lit(1)).alias("n"))
        cells = materialize(cells)  # every effect table of every fold reads the cell sums
        train = cells.join(_training_years(cells, folds, keys), "year")
        effects = E.effects_from_cells(train, keys)
        val = df.join(folds.select(*keys, F.col("val_year").alias("year")), "year")
        scored = E.additive_predict(val, effects, keys)
        return _fold_scores(scored, target, keys)
    df = materialize(df)  # every fold reads the rows several times
    out = []
    for f in folds.orderBy("fold_idx").collect():  # one row per validation year
        train = df.filter(F.col("year") <= f["train_year_max"])
        val = df.filter(F.col("year") == f["val_year"])
        scored = predict(val, fit(train)).withColumns({k: F.lit(f[k]) for k in keys})
        out.append(_fold_scores(scored, target, keys))
    return reduce(DataFrame.unionByName, out)


def _training_years(table: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """``(fold keys, year)`` for every year of ``table`` that a fold trains on; both sides are a few rows."""
    years = table.select("year").distinct()
    return folds.select(*keys).join(years, F.col("year") <= F.col("train_year_max"))


def _year_products(rows: DataFrame, width: int) -> DataFrame:
    """``year, i, products``: row i of the sum over a year of v·vᵀ, v being 1, the inputs and the target.

    Tasks add up whole matrices per year before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, width)
            years = b.column(0).to_numpy()
            for y in np.unique(years).tolist():
                part = v[years == y]
                sums[y] = sums.get(y, 0.0) + part.T @ part
        for y, m in sums.items():
            ends = pa.array(np.arange(0, width * width + 1, width, dtype=np.int32))
            yield pa.record_batch([pa.array([y] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], names=["year", "i", "products"])

    parts = rows.mapInArrow(run, "year long, i int, products array<double>")
    total = Summarizer.metrics("sum").summary(array_to_vector("products"))
    return parts.groupBy("year", "i").agg(total.alias("s")).select("year", "i", vector_to_array("s.sum").alias("products"))


def _solve_ridge(a: np.ndarray, reg: float, n_markers: int) -> tuple[float, np.ndarray]:
    """Intercept and slopes on the inputs' own scale from the products of one fold."""
    n, d = a[0, 0], len(a) - 2
    mean, target = a[0, 1:-1] / n, a[0, -1] / n
    cov = a[1:-1, 1:-1] / n - np.outer(mean, mean)
    with_target = a[1:-1, -1] / n - mean * target
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[scale <= SPREAD_MIN * np.maximum(1.0, np.abs(mean))] = 1.0
    used = np.ones(d, bool)
    if n_markers:
        p = np.clip(mean[d - n_markers :] / 2.0, 0.0, 1.0)
        std = np.sqrt(2.0 * p * (1.0 - p))
        used[d - n_markers :] = std > MARKER_STD_MIN
        scale[d - n_markers :] = np.where(std > MARKER_STD_MIN, std, 1.0)
    z = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    root = np.linalg.cholesky(z + reg * np.eye(used.sum()))
    w = np.linalg.solve(root.T, np.linalg.solve(root, with_target[used] / scale[used]))
    slope = np.zeros(d)
    slope[used] = w / scale[used]
    return float(target - slope @ mean), slope


def rolling_ridge(df: DataFrame, folds: DataFrame, features: list[str], markers: str | None = None, target: str = "yield_mg", reg: float = 1.0) -> DataFrame:
    """Per fold: ridge regression on standardised inputs fitted on its training years, scored on its validation year.

    Inputs are the columns of ``features`` (each over its standard deviation, as ``fit_scaler`` does) and
    the dosages of the array ``markers`` (over √(2p(1−p)), those without spread left out, as
    ``fit_marker_stats`` does). Minimises mean squared error plus ``reg`` times the squared weights of the
    standardised inputs, without a penalty on the intercept. All folds share one scan: products of
    inputs are summed per year, added up per fold and solved by Cholesky, a fold a task.
    """
    if not reg > 0:
        raise TrialError("reg must be positive")
    keys = ["fold_idx", "train_year_max", "val_year"]
    inputs = F.array(*[X.coerce_number(c) for c in features]) if features else F.array().cast("array<double>")
    n_markers = 0
    if markers is not None:
        first = df.select(F.size(markers).alias("n")).filter("n > 0").first()
        n_markers = first["n"] if first else 0
        inputs = F.concat(inputs, F.transform(X.dosage(markers), lambda d: d.cast("double")))
    width = len(features) + n_markers + 2
    ready = df.select("year", "env", F.col(target).cast("double").alias(target), inputs.alias("x"))
    whole = F.concat(F.array(F.lit(1.0)), "x", F.array(target))
    usable = ready.filter(finite(target)).select(F.col("year").cast("long").alias("year"), whole.alias("v"))
    by_year = materialize(_year_products(usable, width))
    per_fold = by_year.join(_training_years(by_year, folds, keys), "year").groupBy(*keys, "i")
    total = per_fold.agg(Summarizer.metrics("sum").summary(array_to_vector("products")).alias("s")).select(*keys, "i", vector_to_array("s.sum").alias("products"))

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        a = np.vstack(table.column("products").to_pylist())[order]
        intercept, slope = _solve_ridge(a, reg, n_markers)
        one = table.select(keys).slice(0, 1)
        return one.append_column("intercept", pa.array([intercept])).append_column("slope", pa.array([slope.tolist()], pa.list_(pa.float64())))

    types = dict(total.dtypes)
    fitted = total.groupBy(*keys).applyInArrow(solve, ", ".join(f"{k} {types[k]}" for k in keys) + ", intercept double, slope array<double>")
    val = ready.join(fitted.withColumn("year", F.col("val_year")), "year")
    pred = F.col("intercept") + F.aggregate(F.zip_with("x", "slope", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    return _fold_scores(val.withColumn("pred", pred).drop("x", "slope"), target, keys)
