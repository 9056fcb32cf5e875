"""Evaluation workflow: scored predictions to scoreboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import ensure_meta
from trialspark.operators import metrics as M
from trialspark.shared import finished, materialize
from trialspark.sources.trials import write_report


def evaluate(scored: DataFrame, train: DataFrame | None = None, out_dir: str | None = None, rank_pred: str = "rank_pred", key: str = "row_key") -> dict[str, DataFrame]:
    """Run, environment, novelty and tester metrics of ``(env, id, actual, pred)`` rows."""

    def build() -> dict[str, DataFrame]:
        rows = ensure_meta(scored)
        if rank_pred not in rows.columns:
            rows = rows.withColumn(rank_pred, F.col("pred"))
        rows = materialize(M.finite_pairs(rows))  # read by every scoreboard
        tables = {
            "run_metrics": M.run_metrics(rows, rank_pred=rank_pred, key=key),
            "env_metrics": M.split_metrics(rows, "env", rank_pred=rank_pred, key=key),
            "env_pcc": M.env_pcc_report(rows, key=key),
            "tester_metrics": M.tester_metrics(rows, rank_pred=rank_pred, key=key),
        }
        if train is not None:
            tables["novelty_metrics"] = M.novelty_metrics(rows, train, rank_pred=rank_pred, key=key)
        if out_dir is not None:
            write_report({"scored_predictions": rows}, out_dir)
        return tables

    tables = finished(scored.sparkSession, build, {"env_pcc": [F.desc("pcc"), "env"], "tester_metrics": [F.desc("n"), "tester"]})
    if out_dir is not None:
        write_report(tables, out_dir)
    return tables
