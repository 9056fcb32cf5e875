"""Best-so-far scans against a plain loop."""

import math

import numpy as np
import pytest

from trialspark.operators import sequences as W


def loop(rows, patience):
    """(best epoch, improved count, stop epoch, best-scale epoch) of one run."""
    best, best_loss, since, improved, scale, scale_at = -math.inf, math.inf, 0, 0, math.inf, None
    at = None
    for epoch, pcc, loss, tm in rows:
        if math.isfinite(pcc):
            better = pcc > best + 1e-8 or (abs(pcc - best) <= 1e-8 and loss < best_loss)
        else:
            better = not math.isfinite(best) and loss < best_loss
        if better:
            best, best_loss, since, at, improved = (pcc if math.isfinite(pcc) else best), loss, 0, epoch, improved + 1
            if tm < scale:
                scale, scale_at = tm, epoch
        else:
            since += 1
        if since > patience:
            return at, improved, epoch, scale_at
    return at, improved, None, scale_at


def runs():
    g = np.random.default_rng(5)
    out = {}
    for r in range(25):
        n = 200 if r == 0 else int(g.integers(1, 40))
        pcc = g.integers(0, 8, n) / 10.0
        if r % 4 == 1:
            pcc = 0.5 + g.integers(-1, 2, n) * 0.7e-8  # ties that drift within the tolerance
        if r % 4 == 2:
            pcc = np.where(g.random(n) < 0.4, np.nan, pcc)
        if r == 3:
            pcc = np.full(n, np.nan)
        if r == 7:
            pcc = 0.9 - 0.9e-8 * np.arange(n)  # every epoch ties with the one before
        loss = np.round(g.random(n), 2) if r != 7 else -np.arange(n, dtype=float)
        out[f"r{r}"] = [(i + 1, float(p), float(v), float(g.integers(0, 9))) for i, (p, v) in enumerate(zip(pcc, loss))]
    return out


@pytest.mark.parametrize("patience,split", [(3, 10**6), (6, 30), (10**6, 10**6)])
def test_trace_matches_loop(spark, patience, split):
    data = runs()
    flat = [(r, e, p, v, t) for r, rows in data.items() for e, p, v, t in rows]
    log = spark.createDataFrame(flat, "run_id string, epoch int, val_pcc double, val_loss double, tm double").repartition(4)
    got = {r["run"]: r for r in W.early_stop_trace(log, patience, scale_mse="tm", split_rows=split).collect()}
    assert set(got) == set(data)
    for r, rows in data.items():
        g = got[r]
        assert (g["best_epoch"], g["n_improved"], g["stop_epoch"], g["best_scale_epoch"]) == loop(rows, patience), r


def test_best_fold_prefers_pcc_then_loss_then_first(spark):
    cols = "fold_idx int, val_year int, best_val_env_avg_pearson double, best_val_loss double, best_checkpoint string"
    nan = float("nan")
    folds = spark.createDataFrame([(0, 2015, nan, 0.1, "a"), (1, 2016, 0.4, 2.0, "b"), (2, 2017, 0.4, 1.0, "c"), (3, 2018, 0.4, 1.0, "d")], cols)
    assert W.best_fold(folds).first()["best_checkpoint"] == "c"
    assert W.latest_fold(folds).first()["best_checkpoint"] == "d"
    assert W.best_fold(folds.limit(0)).count() == 0


def no_rows(parts):
    for pdf in parts:
        assert not len(pdf), "a row reached the loop"
        yield pdf


@pytest.mark.parametrize("falling", [False, True])
def test_equal_scores_send_no_row_to_the_loop(spark, monkeypatch, falling):
    """One run of equal scores in many slices, beside runs of rising and undefined scores."""
    monkeypatch.setattr(W, "_fold_candidates", no_rows)
    n = 30000
    g = np.random.default_rng(1)
    loss = -np.arange(n, dtype=float) if falling else g.random(n)
    rows = [("equal", i, 0.5, float(loss[i])) for i in range(n)]
    rows += [("rising", i, i / 10, 1.0) for i in range(50)] + [("none", i, float("nan"), float(loss[i])) for i in range(50)]
    rows += [("nan first", 0, 0.5, float("nan")), ("nan first", 1, 0.5, 0.1), ("inf", 0, float("nan"), float("inf")), ("inf", 1, float("inf"), 2.0)]
    log = spark.createDataFrame(rows, "run_id string, epoch int, val_pcc double, val_loss double").repartition(4)
    got = {}
    for r in W.improved_epochs(log, split_rows=1000).collect():
        got.setdefault(r["run"], []).append(r["epoch"])
    for run in {r[0] for r in rows}:
        best, low, want = -math.inf, math.inf, []
        for _, epoch, p, v in sorted(r for r in rows if r[0] == run):
            if p > best + 1e-8 and math.isfinite(p) or (math.isfinite(p) and abs(p - best) <= 1e-8 and v < low) or (not math.isfinite(p) and best == -math.inf and v < low):
                best, low = (p if math.isfinite(p) else best), v
                want.append(epoch)
        assert sorted(got.get(run, [])) == want, run


def test_only_drifting_segments_are_walked(spark, monkeypatch):
    seen = []
    real = W.materialize
    monkeypatch.setattr(W, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    steps = [0.1] * 20 + [0.5, 0.5 + 0.6e-8, 0.5 - 0.3e-8, 0.5] + [0.9] * 30
    log = spark.createDataFrame([("r", i, p, float(-i)) for i, p in enumerate(steps)], "run_id string, epoch int, val_pcc double, val_loss double")
    assert [r["epoch"] for r in W.improved_epochs(log, split_rows=8).orderBy("pos").collect()] == [*range(20), 20, 21, 22, 23, *range(24, 54)]
    segments = {r["segment"]: r["n"] for r in seen[0].groupBy("segment").agg(W.F.count("*").alias("n")).collect()}
    assert segments == {1: 20, 2: 4, 3: 30}
