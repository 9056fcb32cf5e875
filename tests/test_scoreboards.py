"""Scoreboards without sorting: plans, and the second look at groups whose spread doesn't settle constancy."""

import math

import numpy as np
import pytest

from trialspark.operators import metrics as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that an operator writes."""
    plans, write = [], M.materialize

    def record(df):
        plans.append(plan(df))
        return write(df)

    monkeypatch.setattr(M, "materialize", record)
    return plans


def rows_of(values, env, preds=None):
    return [(env, f"k{i:03d}", a, p) for i, (a, p) in enumerate(zip(values, preds or [float(i % 7) for i in range(len(values))]))]


BAND = {
    "below": ([1.0, 1.0 + 0.4e-5, 1.0], True),
    "middle first": ([1.0 + 0.75e-5, 1.0, 1.0 + 1.5e-5], True),
    "edge first": ([1.0, 1.0 + 0.75e-5, 1.0 + 1.5e-5], False),
    "above": ([1.0, 1.0 + 5e-5, 1.0], False),
    "around zero": ([0.0, 0.9e-8, -0.9e-8], True),
    "around zero, edge first": ([-0.9e-8, 0.9e-8, 0.0], False),
    "negative, middle first": ([-1e6 + 7.0, -1e6, -1e6 + 14.0], True),
    "negative, edge first": ([-1e6, -1e6 + 7.0, -1e6 + 14.0], False),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "env string, row_key string, actual double, pred double").repartition(4)


def test_the_reference_value_decides_groups_in_the_band(spark):
    rows = [r for name, (values, _) in BAND.items() for r in rows_of(values, name)]
    rows += rows_of([2.0 + 3e-5, 2.0], None) + rows_of([2.0, math.nan], "one pair") + rows_of([None, None], "none")
    got = {r.env: r.pcc for r in M.safe_pcc(frame(spark, rows)).collect()}
    assert {name: got[name] is None for name in BAND} == {name: flat for name, (_, flat) in BAND.items()}
    assert got[None] == pytest.approx(-1.0) and got["one pair"] is None and got["none"] is None
    lines = {r.env: r.slope for r in M.scale_fit(frame(spark, rows)).collect()}
    assert {name: lines[name] is None for name in BAND} == {name: flat for name, (_, flat) in BAND.items()}


@pytest.mark.parametrize("seed", range(3))
def test_flatness_equals_its_definition(spark, seed):
    g = np.random.default_rng(seed)
    rows, flat = [], {}
    for e in range(60):
        base, width = float(g.choice([0.0, 1.0, -3.0, 1e5])), 10 ** g.uniform(-9, 1) * (1 if g.random() < 0.5 else 1e-5)
        v = (base + width * g.random(5)).tolist()
        rows += rows_of(v, f"e{e}")
        flat[f"e{e}"] = max(max(v) - v[0], v[0] - min(v)) <= 1e-8 + 1e-5 * abs(v[0])
    got = {r.env: r.pcc is None for r in M.safe_pcc(frame(spark, rows)).collect()}
    assert got == flat and len(set(flat.values())) == 2


def test_totals_and_boards_take_the_second_look(spark):
    for name, (values, flat) in BAND.items():
        rows = rows_of(values, "x")
        df = frame(spark, rows).withColumn("rank_pred", M.F.col("pred"))
        one = M.run_metrics(df).first()
        assert (one.global_pcc is None, one.slope is None, one.rank_slope is None) == (flat,) * 3, name
        board = M.split_metrics(df, "env").first()
        assert (board.pcc is None, board.rank_pcc is None, board.rank_slope is None) == (flat,) * 3, name


@pytest.mark.parametrize("operator", [M.safe_pcc, M.scale_fit, lambda d: M.split_metrics(d, "env", rank_pred="pred"), lambda d: M.run_metrics(d, rank_pred="pred"), M.env_pcc_report])
def test_no_row_is_sorted(spark, written, operator):
    rows = [r for name, (values, _) in BAND.items() for r in rows_of(values, name)]
    out = operator(frame(spark, rows))
    for p in [*written, plan(out)]:
        assert "SortAggregate" not in p
    assert any("HashAggregate" in p for p in written)


def test_empty_input(spark):
    none = frame(spark, [("e", "k", 1.0, 1.0)]).limit(0)
    assert M.safe_pcc(none).count() == 0 and M.split_metrics(none, "env", rank_pred="pred").count() == 0
    assert M.run_metrics(none, rank_pred="pred").first().global_pcc is None
