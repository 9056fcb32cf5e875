"""Additive decomposition ``y = mu_year + G(hybrid) + E(env) + GE`` and its reports.

Plots are first summed per (environment, hybrid) cell; all effects are then fitted on the much
smaller cell table. ``by`` adds outer keys (for example a fold id) so that several fits run as
one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import finite
from trialspark.operators import ordering as O
from trialspark.schema import TrialError
from trialspark.shared import materialize


@dataclass(frozen=True)
class Effects:
    """Fitted effects: ``mu`` (one row per fit), ``year_effect``, ``hybrid_effect``, ``env_effect``."""

    mu: DataFrame
    year_effect: DataFrame
    hybrid_effect: DataFrame
    env_effect: DataFrame


def env_residuals(df: DataFrame, target: str = "yield_mg", env: str = "env", mean: str = "ymean", resid: str = "resid") -> DataFrame:
    """Add the environment mean of the target and the residual to it.

    The mean is a pre-aggregated table joined back, so a dominant environment is split by the
    engine instead of landing in one window partition.
    """
    means = df.groupBy(env).agg(F.avg(target).alias(mean))
    return df.join(means, env).withColumn(resid, F.col(target) - F.col(mean))


def _universe(df: DataFrame, target: str, train_max: int | None, mask: str | None) -> DataFrame:
    if (train_max is None) == (mask is None):
        raise TrialError("give exactly one of train_max and mask")
    kept = df.filter(F.col("year") <= train_max) if mask is None else df.filter(F.col(mask))
    return kept.filter(finite(target))


def fit_effects(
    df: DataFrame,
    train_max: int | None = None,
    mask: str | None = None,
    target: str = "yield_mg",
    by: list[str] | None = None,
) -> Effects:
    """Year means, hybrid effects and environment effects over the observed universe.

    An empty universe raises when the overall mean is read.
    """
    by = by or []
    seen = _universe(df, target, train_max, mask)
    cells = seen.groupBy(*by, "year", "env", "hybrid").agg(F.sum(target).alias("s"), F.count(F.lit(1)).alias("n"))
    return effects_from_cells(materialize(cells), by)  # every effect table reads the cell sums


def effects_from_cells(cells: DataFrame, by: list[str] | None = None) -> Effects:
    """Fit from cell sums ``(by…, year, env, hybrid, s, n)``."""
    by = by or []
    empty = F.raise_error(F.lit("no rows to fit effects on")).cast("double")
    mu = cells.groupBy(*by).agg(F.when(F.count(F.lit(1)) == 0, empty).otherwise(F.try_divide(F.sum("s"), F.sum("n"))).alias("mu"))
    year = cells.groupBy(*by, "year").agg((F.sum("s") / F.sum("n")).alias("mu_year"))
    dev = cells.join(year, [*by, "year"])
    hybrid = dev.groupBy(*by, "hybrid").agg(
        (F.sum(F.col("s") - F.col("n") * F.col("mu_year")) / F.sum("n")).alias("g_hat"), F.sum("n").alias("n_obs")
    )
    with_g = dev.join(hybrid.drop("n_obs"), [*by, "hybrid"])
    env = with_g.groupBy(*by, "env").agg(
        (F.sum("s") / F.sum("n") - F.max("mu_year") - F.sum(F.col("n") * F.col("g_hat")) / F.sum("n")).alias("e_hat"),
        F.sum("n").alias("n_obs"),
    )
    return Effects(mu, year, hybrid, env)


def attach_effects(df: DataFrame, effects: Effects, target: str | None = "yield_mg", by: list[str] | None = None) -> DataFrame:
    """Left lookup of all effects: unknown hybrid or environment gives 0 with a false flag,
    an unseen year gives the overall mean. With a target, the interaction is added as well."""
    by = by or []
    out = (
        df.join(effects.year_effect, [*by, "year"], "left")
        .join(effects.hybrid_effect.drop("n_obs"), [*by, "hybrid"], "left")
        .join(effects.env_effect.drop("n_obs"), [*by, "env"], "left")
    )
    out = out.join(effects.mu, by, "left") if by else out.join(F.broadcast(effects.mu))  # one row
    out = out.withColumns(
        {
            "mu_year": F.coalesce("mu_year", "mu"),
            "has_g_hat": F.col("g_hat").isNotNull(),
            "has_e_hat": F.col("e_hat").isNotNull(),
            "g_hat": F.coalesce("g_hat", F.lit(0.0)),
            "e_hat": F.coalesce("e_hat", F.lit(0.0)),
        }
    ).drop("mu")
    if target is None:
        return out
    return out.withColumn("ge_hat", F.col(target) - F.col("mu_year") - F.col("g_hat") - F.col("e_hat"))


def interaction_residual(df: DataFrame, effects: Effects, target: str = "yield_mg") -> DataFrame:
    """Rows with known effects and ``ge = y − mu_year − G − E``."""
    full = attach_effects(df, effects, target)
    return full.filter("has_g_hat and has_e_hat").withColumnRenamed("ge_hat", "ge")


def variance_decomposition(df: DataFrame, target: str = "yield_mg") -> DataFrame:
    """Sample variances of the parts, the cross term and the shares of the total."""
    parts = {"year": "mu_year", "env": "e_hat", "hybrid": "g_hat", "interaction": "ge"}
    m = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp(target).alias("var_total"),
        *[F.var_samp(c).alias(f"var_{name}") for name, c in parts.items()],
    )
    total = F.col("var_total")
    m = m.withColumn("var_cross", total - sum((F.col(f"var_{n}") for n in parts), F.lit(0.0)))
    return m.withColumns({f"share_{n}": F.try_divide(F.col(f"var_{n}"), total) for n in (*parts, "cross")})


def hybrid_obs_profile(df: DataFrame, min_obs: int = 3, hybrid: str = "hybrid") -> DataFrame:
    """Observations per hybrid: spread and counts of thin hybrids."""
    per = materialize(df.groupBy(hybrid).agg(F.count(F.lit(1)).alias("n")))
    middle = O.medians(per, [], "n", "median_obs")
    rest = per.agg(
        F.count(F.lit(1)).alias("n_hybrids"),
        F.min("n").alias("min_obs"),
        F.avg("n").alias("mean_obs"),
        F.max("n").alias("max_obs"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.count_if(F.col("n") >= 3).alias("n_three_plus"),
        F.count_if(F.col("n") < min_obs).alias("n_below_min"),
    )
    return rest.join(F.broadcast(middle))  # one row each


def tester_distribution(df: DataFrame, k: int = 10, tester: str = "parent2", hybrid: str = "hybrid") -> DataFrame:
    """Rows and distinct hybrids of the k largest testers."""
    per = df.groupBy(tester).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(hybrid).alias("n_hybrids"))
    return per.orderBy(F.desc("n_rows"), tester).limit(k)


def _uncovered(held: DataFrame, effect: DataFrame, key: str, name: str) -> DataFrame:
    keys = held.select(key).distinct().join(effect.select(key).withColumn("__fit", F.lit(1)), key, "left")
    missing = F.count_if(F.col("__fit").isNull())
    return keys.agg(
        F.count(F.lit(1)).alias("n_keys"), missing.alias("n_missing"), F.try_divide(missing * 100.0, F.count(F.lit(1))).alias("pct_missing")
    ).select(F.lit(name).alias("part"), "n_keys", "n_missing", "pct_missing")


def heldout_coverage(df: DataFrame, effects: Effects, mask: str) -> DataFrame:
    """Held-out hybrids and environments (mask false) without a fitted effect."""
    held = df.filter(~F.col(mask))
    return _uncovered(held, effects.hybrid_effect, "hybrid", "hybrid").unionByName(
        _uncovered(held, effects.env_effect, "env", "env")
    )


def effect_stats(effects: Effects) -> DataFrame:
    """Count, mean, population std, min and max of each effect table."""
    out = None
    for name, table, col in (
        ("hybrid", effects.hybrid_effect, "g_hat"),
        ("env", effects.env_effect, "e_hat"),
        ("year", effects.year_effect, "mu_year"),
    ):
        one = table.agg(
            F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
        ).select(F.lit(name).alias("effect"), "n", "mean", "std", "min", "max")
        out = one if out is None else out.unionByName(one)
    return out


def additive_predict(df: DataFrame, effects: Effects, by: list[str] | None = None) -> DataFrame:
    """Network-free prediction ``mu_year + G + E`` with the lookup fallbacks."""
    full = attach_effects(df, effects, None, by)
    return full.withColumn("pred", F.col("mu_year") + F.col("g_hat") + F.col("e_hat"))
