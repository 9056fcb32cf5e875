"""Stacking workflow: prediction files to weights, stacked predictions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import stacking as K
from trialspark.operators.relations import filter_years
from trialspark.shared import finished, materialize
from trialspark.sources.predictions import merge_predictions, read_predictions
from trialspark.sources.trials import write_report


def _models(long: DataFrame) -> list[str]:
    return [r[0] for r in long.select("model").distinct().orderBy("model").collect()]  # one row per file


def stack(
    spark: SparkSession,
    train_files: list[str],
    test_files: list[str] | None = None,
    years: tuple[int | None, int | None] = (None, None),
    n_random: int = K.N_RANDOM,
    seed: int = K.SEARCH_SEED,
    rounds: int = 0,
    out_dir: str | None = None,
    name: str = "stack",
) -> dict[str, DataFrame]:
    """Search weights on the training files (optionally refined) and apply them everywhere."""

    def build() -> dict[str, DataFrame]:
        long = read_predictions(spark, train_files)
        models = _models(long)
        wide = filter_years(merge_predictions(long, models), *years)
        moments = materialize(K.stack_moments(wide, models))
        best = K.search_weights(moments, models, n_random, seed).first()
        weights = [best[f"w_{i}"] for i in range(len(models))]
        if rounds:
            weights, _ = K.refine_weights(moments, models, weights, rounds, seed=seed)
        test, test_models = None, None
        if test_files:
            test_long = read_predictions(spark, test_files)
            test_models = _models(test_long)
            test = merge_predictions(test_long, test_models)
        row = spark.createDataFrame([tuple(weights)], ", ".join(f"w_{i} double" for i in range(len(models))))
        tables = {
            "weights": K.stack_weights_report(row, models),
            "report": K.stack_report(wide, test, models, weights, test_models),
            "train_predictions": K.apply_stack(wide, models, weights, name),
        }
        if test is not None:
            tables["test_predictions"] = K.apply_stack(test, models, weights, name)
        return tables

    tables = finished(spark, build, {"weights": [F.desc("weight"), "model"]})
    if out_dir is not None:
        write_report(tables, out_dir)
    return tables
