"""Rank metrics against brute force, on plain windows and on the split path for large groups."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import metrics as M
from trialspark.operators import ordering as O
from trialspark.operators import pair_counts as PC
from trialspark.operators import pairs as PJ
from trialspark.operators import ranking as R


def rows_with_hot_group(seed=3, n=240):
    """A third of all rows in one environment, half of its targets equal, many ties elsewhere."""
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        env = "hot" if i % 3 == 0 else f"e{g.integers(0, 7)}"
        a = 1.0 if env == "hot" and i % 2 == 0 else float(g.integers(0, 12)) / 4
        p = float(g.integers(0, 9)) / 4
        out.append((env, f"k{i:04d}", a, p))
    return out


@pytest.fixture(scope="module")
def data():
    return rows_with_hot_group()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "env string, row_key string, actual double, pred double").repartition(5)


def by_env(data):
    out = {}
    for env, k, a, p in data:
        out.setdefault(env, []).append((k, a, p))
    return out


def avg_rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


SPLITS = [10**6, 15]


@pytest.mark.parametrize("split", SPLITS)
def test_positions_are_exact(df, data, split):
    got = {(r["env"], r["row_key"]): r["position"] for r in O.positions(df, ["env"], [F.desc("pred"), F.col("row_key")], split_rows=split).collect()}
    for env, rows in by_env(data).items():
        want = sorted(rows, key=lambda r: (-r[2], r[0]))
        assert [got[env, k] for k, _, _ in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("split", SPLITS)
def test_running_maximum(df, data, split):
    out = O.running_sums(df, ["env"], [F.col("row_key")], {"s": F.col("pred")}, split, maxima={"m": F.col("actual")})
    got = {(r["env"], r["row_key"]): (r["s"], r["m"]) for r in out.collect()}
    for env, rows in by_env(data).items():
        s, m = 0.0, -math.inf
        for k, a, p in sorted(rows):
            s, m = s + p, max(m, a)
            assert got[env, k] == pytest.approx((s, m))


@pytest.mark.parametrize("split", SPLITS)
def test_spearman(df, data, split):
    a, p = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    got = R.spearman(df, split_rows=split).first()
    assert got["spearman"] == pytest.approx(np.corrcoef(avg_rank(a), avg_rank(p))[0, 1])
    per = {r["env"]: r["spearman"] for r in R.env_spearman(df, split_rows=split).collect()}
    for env, rows in by_env(data).items():
        ra, rp = avg_rank([r[1] for r in rows]), avg_rank([r[2] for r in rows])
        n = len(rows)
        assert per[env] == pytest.approx(1 - 6 * ((ra - rp) ** 2).sum() / (n * (n * n - 1)))


@pytest.mark.parametrize("split", SPLITS)
def test_ktau(df, data, split):
    got = {r["env"]: r for r in R.ktau(df, "env", split_rows=split).collect()}
    for env, rows in by_env(data).items():
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        c = sum(x[1] < y[1] for x, y in itertools.combinations(rows, 2))
        d = sum(x[1] > y[1] for x, y in itertools.combinations(rows, 2))
        assert (got[env]["n"], got[env]["concordant"], got[env]["discordant"]) == (len(rows), c, d)


def test_ktau_over_all_rows(df, data):
    rows = sorted(data, key=lambda r: (r[3], r[1]))
    c = sum(x[2] < y[2] for x, y in itertools.combinations(rows, 2))
    d = sum(x[2] > y[2] for x, y in itertools.combinations(rows, 2))
    got = R.ktau(df, [], split_rows=40).first()
    assert (got["concordant"], got["discordant"]) == (c, d)


@pytest.mark.parametrize("split", SPLITS)
def test_tau_b_with_ties(df, data, split):
    got = {r["env"]: r["tau_b"] for r in R.tau_b(df, ["env"], split_rows=split).collect()}
    for env, rows in by_env(data).items():
        s = sum(np.sign(x[1] - y[1]) * np.sign(x[2] - y[2]) for x, y in itertools.combinations(rows, 2))
        na = sum(x[1] != y[1] for x, y in itertools.combinations(rows, 2))
        np_ = sum(x[2] != y[2] for x, y in itertools.combinations(rows, 2))
        assert got[env] == pytest.approx(s / math.sqrt(na * np_))


@pytest.mark.parametrize("split", SPLITS)
def test_rank_hinge(df, data, split):
    total, n = 0.0, 0
    for rows in by_env(data).values():
        if len(rows) < 3:
            continue
        for x, y in itertools.permutations(rows, 2):
            if y[1] < x[1] - 0.2:
                n += 1
                total += max(0.0, 0.5 - (x[2] - y[2]))
    got = R.rank_hinge(df, split_rows=split).first()
    assert got["n_pairs"] == n and got["hinge"] == pytest.approx(total / n)


def test_rank_hinge_without_pairs(spark):
    df = spark.createDataFrame([("e", f"k{i}", 1.0, float(i)) for i in range(4)] + [("two", "a", 0.0, 0.0), ("two", "b", 5.0, 0.0)], "env string, row_key string, actual double, pred double")
    assert tuple(R.rank_hinge(df).first()) == (0, 0.0)


@pytest.mark.parametrize("split", SPLITS)
def test_rank_consistency(df, data, split):
    losses = []
    for rows in by_env(data).values():
        if len(rows) < 2:
            continue
        order = lambda i: {k: n for n, (k, *_) in enumerate(sorted(rows, key=lambda r: (r[i], r[0])))}
        a, p = order(1), order(2)
        losses.append(1 - np.corrcoef([a[k] for k, *_ in rows], [p[k] for k, *_ in rows])[0, 1])
    got = R.rank_consistency(df, "env", split_rows=split).first()
    assert got["n_hybrids"] == len(losses) and got["loss"] == pytest.approx(np.mean(losses))


@pytest.mark.parametrize("split", SPLITS)
def test_pair_summary(df, data, split):
    got = {r["env"]: r for r in PJ.ordered_pair_summary(df, "env", "actual", "row_key", split).collect()}
    for env, rows in by_env(data).items():
        gap = sum(abs(x[1] - y[1]) for x, y in itertools.combinations(rows, 2))
        assert got[env]["n_pairs"] == math.comb(len(rows), 2) and got[env]["gap_sum"] == pytest.approx(gap)


def rows_with_gaps(seed=8, n=40):
    """NULL and NaN groups, actuals and predictions among ties."""
    g = np.random.default_rng(seed)
    values = [None, math.nan, 0.0, 0.5, 1.0, 2.0]
    envs = ["a", "b", None, "c"]
    return [(envs[g.integers(4)], f"k{i:04d}", values[g.integers(6)], values[g.integers(6)]) for i in range(n)]


def same(rows):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize(
    "operator",
    [
        lambda df, s: O.average_ranks(df, ["env"], "actual", "r", s),
        lambda df, s: O.dense_ranks(df, ["env"], "actual", "r", s),
        lambda df, s: O.running_sums(df, ["env"], [F.col("row_key")], {"t": F.when(F.col("actual") < 9, F.col("actual"))}, s),
        lambda df, s: R.env_spearman(df, split_rows=s),
        lambda df, s: R.spearman(df, split_rows=s),
        lambda df, s: R.spearman(df, by=["env"], split_rows=s),
        lambda df, s: R.ktau(df, split_rows=s),
        lambda df, s: R.tau_b(df, ["env"], split_rows=s),
        lambda df, s: R.rank_hinge(df, split_rows=s),
        lambda df, s: R.rank_consistency(df, "env", split_rows=s),
    ],
)
def test_gaps_give_the_same_rows_on_both_paths(spark, operator):
    df = spark.createDataFrame(rows_with_gaps(), "env string, row_key string, actual double, pred double").repartition(4)
    window, split = operator(df, 10**6).collect(), operator(df, 1).collect()
    assert same(window) == same(split) and len(window) > 0


def test_null_group_keeps_its_ranks(spark):
    df = spark.createDataFrame([(None, "x", 1.0, 2.0), (None, "y", 2.0, 1.0), ("a", "z", None, 1.0), ("a", "w", 3.0, 2.0)], "env string, row_key string, actual double, pred double")
    for s in (10**6, 1):
        got = {r["env"]: r["tau_b"] for r in R.tau_b(df, ["env"], split_rows=s).collect()}
        assert got == {None: -1.0, "a": 1.0}


def test_rank_terms_share_the_rows_that_are_written(spark, monkeypatch):
    """Against brute force, with a NULL environment, repeated and NULL keys and equal values; the rows are written once for all terms."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 5 == 4 else f"E{i % 5}", "same" if i % 7 == 0 else None if i % 11 == 0 else f"r{i}", float(rng.integers(0, 30)) / 10, float(rng.integers(0, 40)) / 10) for i in range(203)]
    written = []
    for module in (M, O, R, PC):
        monkeypatch.setattr(module, "materialize", lambda df, f=module.materialize: written.append((t := f(df)).count()) or t)
    df = spark.createDataFrame(rows, "env string, row_key string, actual double, pred double")
    got = {r["term"]: r["value"] for r in M.composite_score(df, "envspearman+triplet").collect()}

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    rhos, hinges = [], []
    for env in {r[0] for r in rows}:
        a, p = (np.array([r[c] for r in rows if r[0] == env]) for c in (2, 3))
        rhos.append(1 - 6 * ((ranks(a) - ranks(p)) ** 2).sum() / (len(a) * (len(a) ** 2 - 1)))
        hinges += [max(0.0, 0.5 - (p[i] - p[j])) for i in range(len(a)) for j in range(len(a)) if a[j] < a[i] - 0.2]
    assert got["envspearman"] == pytest.approx(1 - np.mean(rhos)) and got["triplet"] == pytest.approx(np.mean(hinges))
    assert written.count(len(rows)) == 1
