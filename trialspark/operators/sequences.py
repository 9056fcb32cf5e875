"""Ordered scans over metric logs and pick-the-best operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.expressions import finite
from trialspark.operators import ordering as O
from trialspark.shared import materialize, null_safe_join

# Fixed value that results depend on.
IMPROVE_EPS = 1e-8


def _numbered(log: DataFrame, run: str, epoch: str, pcc: str, loss: str, extra: list[str], split_rows: int) -> DataFrame:
    """Rows with their 1-based place in the run and the best finite PCC up to and including, and before them."""
    ok = finite(pcc)
    base = log.select(
        F.col(run).alias("run"), F.col(epoch).alias("epoch"), F.when(ok, F.col(pcc).cast("double")).alias("pcc"), F.col(loss).cast("double").alias("loss"), *extra
    )
    return O.running_sums(
        base, ["run"], [F.col("epoch")], {"pos": F.lit(1).cast("long"), "n_finite": F.col("pcc").isNotNull().cast("long")}, split_rows, maxima={"top": F.col("pcc")}, maxima_before={"top_before": F.col("pcc")}
    )


def _fold_candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (run, segment, pos) and keep those that improve on the best so far."""
    at, best, best_loss = None, -math.inf, math.inf
    for pdf in parts:
        keep = []
        for r, g, p, v in zip(pdf["run_key"].to_numpy(), pdf["segment"].to_numpy(), pdf["pcc"].to_numpy(), pdf["loss"].to_numpy()):
            if (r, g) != at:
                at, best, best_loss = (r, g), -math.inf, math.inf
            better = p > best + IMPROVE_EPS or (abs(p - best) <= IMPROVE_EPS and v < best_loss)
            if better:
                best, best_loss = p, v
            keep.append(better)
        yield pdf[keep]


def improved_epochs(
    log: DataFrame, run: str = "run_id", epoch: str = "epoch", pcc: str = "val_pcc", loss: str = "val_loss", extra: list[str] | None = None, split_rows: int = O.SPLIT_ROWS
) -> DataFrame:
    """Epochs that become the best so far: ``(run, pos, epoch, pcc, loss, extra…)``.

    A row that passes the running maximum before it by more than the tolerance improves whatever came
    before, so it resets the state and cuts the run into segments that don't depend on each other.
    Inside a segment whose values near the reset are all equal to it, and before the first
    finite value, a row improves exactly by a new lowest loss: a running minimum over slices. Only
    segments where values drift within the tolerance are walked row by row, each on its own and in
    constant memory, as there the best value may move down and a later row may beat it again.
    """
    extra = extra or []
    return _improved(_numbered(log, run, epoch, pcc, loss, extra, split_rows), extra, split_rows)


def _improved(numbered: DataFrame, extra: list[str], split_rows: int = O.SPLIT_ROWS) -> DataFrame:
    slack = F.lit(IMPROVE_EPS) * (F.col("pos") + 1)  # each tie moves the best down by the tolerance at most
    candidate = F.when(F.col("pcc").isNotNull(), F.col("pcc") >= F.col("top") - slack).otherwise(F.col("n_finite") == 0)
    columns = ["run", "pos", "epoch", "pcc", "loss", *extra]
    near, rows = O.counted(numbered.filter(candidate).select(*columns, "top_before"))
    finite_row = F.col("pcc").isNotNull()
    reset = finite_row & (F.col("top_before").isNull() | (F.col("pcc") > F.col("top_before") + IMPROVE_EPS))
    marked = near.withColumn("reset", F.coalesce(reset, F.lit(False))).drop("top_before")
    cut = O.running_sums(marked, ["run"], [F.col("pos")], {"segment": F.col("reset").cast("long")}, split_rows, rows)
    heads = cut.filter("reset").select("run", "segment", F.col("pcc").alias("head_pcc"), F.col("loss").alias("head_loss"))
    known = materialize(null_safe_join(cut, heads, ["run", "segment"], "left"))
    odd = finite_row & (F.col("pcc") != F.col("head_pcc")) & (F.abs(F.col("pcc") - F.col("head_pcc")) <= IMPROVE_EPS)
    drifting = known.filter(odd).select("run", "segment").distinct()
    held = F.col("loss").isNotNull() & ~F.isnan("loss")
    ties = null_safe_join(known, drifting, ["run", "segment"], "left_anti").filter(~finite_row | (F.col("pcc") == F.col("head_pcc")))
    lowest = O.running_sums(ties, ["run", "segment"], [F.col("pos")], {}, split_rows, rows, maxima_before={"low": F.when(held, -F.col("loss"))})
    first_held = F.col("head_loss").isNotNull() & ~F.isnan("head_loss")
    lower = held & (F.col("loss") < F.coalesce(-F.col("low"), F.lit(float("inf"))))
    better = lowest.filter(F.col("reset") | (F.when(finite_row, first_held & lower).otherwise(lower))).select(*columns)
    walked = null_safe_join(known, drifting, ["run", "segment"], "left_semi").select(*columns, F.col("run").cast("string").alias("run_key"), "segment")
    walked = walked.repartition("run", "segment").sortWithinPartitions("run_key", "segment", "pos")
    return better.unionByName(walked.mapInPandas(_fold_candidates, walked.schema).select(*columns))


def early_stop_trace(
    log: DataFrame, patience: int, run: str = "run_id", epoch: str = "epoch", pcc: str = "val_pcc", loss: str = "val_loss", scale_mse: str | None = None, split_rows: int = O.SPLIT_ROWS
) -> DataFrame:
    """Per run: best epoch with its metrics and the epoch training stops at (NULL if it runs out).

    Training stops at the first epoch with more than ``patience`` epochs since the last
    improvement; improvements after that do not count. With ``scale_mse`` the improved epoch of
    lowest total error is reported as well.
    """
    extra = [scale_mse] if scale_mse else []
    numbered = materialize(_numbered(log, run, epoch, pcc, loss, extra, split_rows))  # read three times below
    best = materialize(_improved(numbered, extra, split_rows))
    sizes = numbered.groupBy("run").agg(F.max("pos").alias("n_epochs"))
    # place 0 stands for the start of training, so a run that never improves stops too
    start = sizes.select("run", F.lit(0).cast("long").alias("pos"))
    marks = best.unionByName(start, allowMissingColumns=True)
    w = Window.partitionBy("run").orderBy("pos")  # improved epochs only
    gaps = marks.withColumn("nxt", F.lead("pos").over(w)).join(sizes, "run")
    limit = F.col("pos") + patience + 1
    stops = (F.col("nxt").isNull() | (F.col("nxt") > limit)) & (limit <= F.col("n_epochs"))
    flagged = gaps.withColumn("stop_here", F.when(stops, limit))
    cut = flagged.groupBy("run").agg(F.min("stop_here").alias("stop_pos"), F.max("n_epochs").alias("n_epochs"))
    kept = marks.filter("pos > 0").join(cut, "run").filter(F.col("stop_pos").isNull() | (F.col("pos") <= F.col("stop_pos")))
    picks = [
        F.max_by("epoch", "pos").alias("best_epoch"),
        F.max_by("pcc", "pos").alias("best_pcc"),
        F.max_by("loss", "pos").alias("best_loss"),
        F.count(F.lit(1)).alias("n_improved"),
    ]
    if scale_mse:
        usable = F.when(finite(scale_mse), F.struct(F.col(scale_mse), F.col("pos")))
        picks.append(F.min_by("epoch", usable).alias("best_scale_epoch"))
    chosen = kept.groupBy("run").agg(*picks)
    out = cut.join(chosen, "run", "left")
    places = numbered.select("run", F.col("pos").alias("stop_pos"), F.col("epoch").alias("stop_epoch"))
    out = out.join(places, ["run", "stop_pos"], "left").withColumn("n_improved", F.coalesce("n_improved", F.lit(0)))
    cols = ["run", "best_epoch", "best_pcc", "best_loss", "n_improved", "stop_epoch", "n_epochs"]
    return out.select(*cols, *(["best_scale_epoch"] if scale_mse else []))


def best_scale_epoch(log: DataFrame, patience: int, scale_mse: str = "total_env_mse", **kw) -> DataFrame:
    """Improved epoch with the lowest total environment MSE per run."""
    return early_stop_trace(log, patience, scale_mse=scale_mse, **kw).select("run", "best_scale_epoch")


def rank_concordance(runs: DataFrame, tag: str = "tag", cv: str = "cv_val_pcc", test: str = "test_pcc") -> DataFrame:
    """Ranks by CV and by test (0 = best) of runs with both scores, and whether the CV-best run is
    in the test top two and the CV-worst in the bottom two."""
    ok, rows = O.counted(runs.filter(finite(cv) & finite(test)).select(tag, cv, test))
    ranked = O.positions(ok, [], [F.desc(cv), F.col(tag)], "cv_rank", known=rows)
    ranked = O.positions(ranked, [], [F.desc(test), F.col(tag)], "test_rank", known=rows)
    ranked = ranked.withColumns({"cv_rank": F.col("cv_rank") - 1, "test_rank": F.col("test_rank") - 1})
    last = F.lit(rows - 1)
    return ranked.withColumns(
        {
            "cv_best_in_top2": F.when(F.col("cv_rank") == 0, F.col("test_rank") <= 1),
            "cv_worst_in_bottom2": F.when(F.col("cv_rank") == last, F.col("test_rank") >= last - 1),
        }
    )


def _score_order(pcc: str, loss: str):
    low = F.lit(float("-inf"))
    return F.struct(F.when(finite(pcc), F.col(pcc)).otherwise(low), F.when(finite(loss), -F.col(loss)).otherwise(low))


def best_fold(folds: DataFrame, pcc: str = "best_val_env_avg_pearson", loss: str = "best_val_loss", tie: str = "fold_idx") -> DataFrame:
    """The record with the highest PCC, then the lowest loss, then the first fold."""
    order = F.struct(_score_order(pcc, loss), -F.col(tie))
    return folds.agg(F.max_by(F.struct(*folds.columns), order).alias("r")).filter("r is not null").select("r.*")


def latest_fold(folds: DataFrame, year: str = "val_year", tie: str = "fold_idx") -> DataFrame:
    order = F.struct(F.col(year), -F.col(tie))
    return folds.agg(F.max_by(F.struct(*folds.columns), order).alias("r")).filter("r is not null").select("r.*")
