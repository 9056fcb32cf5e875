"""Ridge over year sums against normal equations per fold, medians and drift against plain Python."""

import math
import statistics

import numpy as np
import pytest

from trialspark.operators import ordering as O
from trialspark.operators import population as P
from trialspark.operators import selection as V


def rows(seed=4, n=400):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        markers = g.choice([0.0, 0.5, 1.0], 6, p=[0.5, 0.3, 0.2])
        markers[5] = 1.0  # without spread
        x = [float(g.normal(5, 2)), float(g.integers(0, 4)), 7.0]  # the last one is constant
        y = x[0] * 0.5 - x[1] + markers[:5] @ [1, 2, 0, -1, 0.5] + g.normal()
        out.append((2010 + i % 5, f"e{i % 15}", None if i % 40 == 0 else float(y), *x, markers.tolist()))
    return out


def slow(data, folds, reg, with_markers):
    out = {}
    for f, last, val in folds:
        def x_of(r):
            return np.array([*r[3:6], *([2 * m for m in r[6]] if with_markers else [])])

        train = [r for r in data if r[0] <= last and r[2] is not None]
        x, y = np.array([x_of(r) for r in train]), np.array([r[2] for r in train])
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        if with_markers:
            p = mean[3:] / 2
            std = np.sqrt(2 * p * (1 - p))
            scale[3:] = np.where(std > 1e-9, std, np.inf)
        z = (x - mean) / scale
        w = np.linalg.solve(z.T @ z / len(y) + reg * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(y))
        test = [r for r in data if r[0] == val and r[2] is not None]
        pred = [(((x_of(r) - mean) / scale) @ w + y.mean(), r[2], r[1]) for r in test]
        rs = []
        for e in {p[2] for p in pred}:
            a, b = zip(*[(p[0], p[1]) for p in pred if p[2] == e])
            rs.append(np.corrcoef(a, b)[0, 1])
        out[f] = (len(pred), np.mean(rs), np.mean([(a - b) ** 2 for a, b, _ in pred]))
    return out


@pytest.mark.parametrize("with_markers", [False, True])
def test_ridge(spark, with_markers):
    data, folds = rows(), [(0, 2011, 2012), (1, 2012, 2013), (2, 2013, 2014)]
    df = spark.createDataFrame(data, "year int, env string, yield_mg double, a double, b double, c double, markers array<double>").repartition(5)
    table = spark.createDataFrame(folds, "fold_idx int, train_year_max int, val_year int")
    got = {r["fold_idx"]: (r["n_val"], r["env_pcc"], r["mse"]) for r in V.rolling_ridge(df, table, ["a", "b", "c"], "markers" if with_markers else None, reg=0.3).collect()}
    want = slow(data, folds, 0.3, with_markers)
    assert got.keys() == want.keys()
    for f in want:
        assert got[f] == pytest.approx(want[f], rel=1e-9)
    with pytest.raises(V.TrialError):
        V.rolling_ridge(df, table, ["a"], reg=0)


@pytest.mark.parametrize("split", [10**6, 7])
def test_medians(spark, split):
    g = np.random.default_rng(0)
    data = [("hot" if i % 3 else [None, "a"][i % 2], None if i % 11 == 0 else float(g.integers(0, 12))) for i in range(200)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    want = {}
    for k in {d[0] for d in data}:
        vals = [v for h, v in data if h == k and v is not None]
        want[k] = statistics.median(vals) if vals else None
    assert {r["g"]: r["median"] for r in O.medians(df, ["g"], "v", split_rows=split).collect()} == want
    assert O.medians(df, [], "v", split_rows=split).first()["median"] == statistics.median([v for _, v in data if v is not None])
    assert [r["median"] for r in O.medians(df.limit(0), [], "v").collect()] == [None] and O.medians(df.limit(0), ["g"], "v").count() == 0


def test_drift_leaves_missing_features_out(spark):
    data = [(2000, "x", 1.0, None), (2000, "x", 3.0, None), (2001, "x", 5.0, 2.0), (2000, "y", 1.0, 1.0), (2001, "y", 1.0, 4.0), (2001, "z", 1.0, 1.0), (2000, "w", None, None), (2001, "w", None, 1.0)]
    df = spark.createDataFrame(data, "year int, location string, f1 double, f2 double")
    r = P.covariate_drift_chain(df, ["f1", "f2"]).orderBy("year").collect()
    # x: |2-5| over f1 alone; y: (0 + 3) / 2; w shares no feature
    assert [(x["year"], x["other_year"], x["n_locations"], x["mean_diff"], x["max_diff"]) for x in r] == [(2000, 2001, 3, pytest.approx(2.25), 3.0)]
    assert r[0]["std_diff"] == pytest.approx(0.75) and not math.isnan(r[0]["std_diff"])
    plan = P.covariate_drift(df, 2000, 2001, ["f1", "f2"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
