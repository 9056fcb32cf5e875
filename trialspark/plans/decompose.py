"""Decomposition workflow: observed universe, effects, residuals, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import ensure_meta
from trialspark.operators import effects as E
from trialspark.operators import splits as D
from trialspark.shared import finished, materialize

EFFECTS = ["mu", "year_effect", "hybrid_effect", "env_effect"]


def decompose(
    trials: DataFrame, target: str = "yield_mg", train_max: int | None = None, leo_envs: DataFrame | None = None, test_year: int = D.TEST_YEAR, min_obs: int = 3
) -> tuple[E.Effects, dict[str, DataFrame]]:
    """Effects fitted on the observed rows, and the diagnostic tables."""

    def build() -> dict[str, DataFrame]:
        rows = ensure_meta(trials)
        if train_max is not None:
            rows = rows.withColumn("observed", F.col("year") <= train_max)
        else:
            rows = D.observed_mask(rows, leo_envs, test_year)
        fitted = E.fit_effects(rows, mask="observed", target=target)
        # the effect tables are read by every report below
        effects = E.Effects(*[materialize(t) for t in (fitted.mu, fitted.year_effect, fitted.hybrid_effect, fitted.env_effect)])
        seen = rows.filter("observed")
        return dict(zip(EFFECTS, (effects.mu, effects.year_effect, effects.hybrid_effect, effects.env_effect))) | {
            "variance": E.variance_decomposition(E.interaction_residual(seen, effects, target), target),
            "observations": E.hybrid_obs_profile(seen, min_obs),
            "testers": E.tester_distribution(seen),
            "coverage": E.heldout_coverage(rows, effects, "observed"),
            "effects": E.effect_stats(effects),
        }

    tables = finished(trials.sparkSession, build)
    return E.Effects(*[tables.pop(name) for name in EFFECTS]), tables
