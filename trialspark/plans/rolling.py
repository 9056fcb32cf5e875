"""Rolling-origin cross-validation: folds, fit and predict per fold, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import ensure_meta
from trialspark.operators import selection as V
from trialspark.operators import splits as D
from trialspark.shared import finished


def rolling_cv(trials: DataFrame, start: int, end: int, target: str = "yield_mg", fit=None, predict=None, **fold_options) -> dict[str, DataFrame]:
    """Fold records in the shape the selection operators expect, and their summary."""
    rows = ensure_meta(trials)
    folds = D.fold_table(rows.sparkSession, start, end, **fold_options)
    scores = finished(rows.sparkSession, lambda: {"scores": V.rolling_fit_predict(rows, folds, target, fit, predict)})["scores"]
    records = scores.select(
        "fold_idx",
        "train_year_max",
        "val_year",
        F.lit(1).alias("best_epoch"),
        F.col("mse").alias("best_val_loss"),
        F.col("env_pcc").alias("best_val_env_avg_pearson"),
        F.concat(F.lit("fold_"), F.col("val_year").cast("string")).alias("best_checkpoint"),
    )
    return {"scores": scores, "folds": records, "summary": V.fold_summary(records)}
