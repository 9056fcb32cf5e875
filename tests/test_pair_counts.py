"""Pair totals in blocks against all pairs, at every size of a slice."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import ordering as O
from trialspark.operators import pair_counts as PC
from trialspark.operators import ranking as R


@pytest.mark.parametrize("seed", range(25))
def test_kernel_against_all_pairs(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(1, 60))
    group = np.sort(g.integers(0, 4, n))
    group = np.unique(group, return_inverse=True)[1]
    value = g.integers(0, int(g.integers(1, 20)), n).astype(float)
    rank = np.unique(value, return_inverse=True)[1]
    point, asked = g.random(n) < 0.7, g.random(n) < 0.7
    want = np.zeros((3, group[-1] + 1))
    for i, j in itertools.combinations(range(n), 2):
        if group[i] == group[j] and point[i] and asked[j]:
            want[0, group[i]] += value[i] < value[j]
            want[1, group[i]] += value[i] > value[j]
            want[2, group[i]] += max(0.0, value[i] - value[j])
    assert np.allclose(PC.pair_totals(group, rank, value, point, asked), want)


def test_kernel_without_rows():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in PC.pair_totals(none, none, none.astype(float), none.astype(bool), none.astype(bool))] == [0, 0, 0]


def order(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


def brute(rows, weighted):
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        t = dict.fromkeys(["n_rows", "pairs", "set_pairs", "ok_pairs", "below", "above", "gap"], 0)
        t["n_rows"] = len(mine)
        for x, y in itertools.combinations(mine, 2):
            if not (x[3] and y[4]):
                continue
            t["pairs"] += 1
            whole = x[2] is not None and y[2] is not None
            t["set_pairs"] += whole
            ok = whole and math.isfinite(x[2]) and math.isfinite(y[2]) if weighted else True
            t["ok_pairs"] += ok
            if ok:
                t["below"] += order(x[2]) < order(y[2])
                t["above"] += order(x[2]) > order(y[2])
                t["gap"] += max(0.0, x[2] - y[2]) if weighted else 0.0
        out[g] = t
    return out


def sample(seed, n=120):
    """A third of all rows in one group, half of its values equal; NULL, NaN and infinite values and a NULL group."""
    g = np.random.default_rng(seed)
    values = [None, math.nan, math.inf, -math.inf, *[float(x) / 2 for x in range(8)]]
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        v = 1.0 if hot and i % 2 == 0 else values[g.integers(len(values))]
        rows.append(("hot" if hot else [None, "a", "b", "c"][g.integers(4)], int(g.permutation(10**6)[0]) * n + i, v, int(g.random() < 0.8), int(g.random() < 0.8)))
    return rows


@pytest.mark.parametrize("slice_rows", [10**6, 40, 7])
@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_totals_against_all_pairs(spark, seed, weighted, slice_rows):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "g string, k long, v double, pt int, q int").repartition(5)
    got = {r["g"]: r.asDict() for r in PC.ordered_pair_totals(df, len(rows), ["g"], [F.col("k")], weighted, slice_rows).collect()}
    want = brute(rows, weighted)
    assert got.keys() == want.keys()
    for g, t in want.items():
        wanted = {c: x for c, x in t.items() if c in ("n_rows", "pairs", "below", "above", "gap") or weighted}
        assert {c: got[g][c] for c in wanted} == pytest.approx(wanted)


@pytest.mark.parametrize("slice_rows", [10**6, 7])
def test_one_group_of_all_rows_and_equal_values(spark, slice_rows):
    equal = spark.range(200).selectExpr("id as k", "3L as v", "1 as pt", "1 as q")
    r = PC.ordered_pair_totals(equal, 200, [], [F.col("k")], slice_rows=slice_rows).first()
    assert (r["pairs"], r["below"], r["above"], r["n_rows"]) == (200 * 199 // 2, 0, 0, 200)
    rising = spark.range(200).selectExpr("id as k", "id as v", "1 as pt", "1 as q")
    r = PC.ordered_pair_totals(rising, 200, [], [F.col("k")], slice_rows=slice_rows).first()
    assert (r["below"], r["above"]) == (200 * 199 // 2, 0)
    assert PC.ordered_pair_totals(equal.limit(0).withColumn("g", F.lit("x")), 0, ["g"], [F.col("k")], slice_rows=slice_rows).count() == 0


def test_rows_go_through_two_shuffles_at_most(spark, monkeypatch):
    """What goes on to the second partitioning is at most the rows, and only those of groups in several slices."""
    written = []
    real = PC.materialize
    monkeypatch.setattr(PC, "materialize", lambda df: written.append(real(df)) or written[-1])
    df = spark.range(4000).selectExpr("id as k", "id % 97 as v", "1 as pt", "1 as q", "if(id < 1000, 'big', concat('s', id % 300)) as g")
    PC.ordered_pair_totals(df, 4000, ["g"], [F.col("k")], slice_rows=500).collect()
    loose = written[1]
    assert {r["g"] for r in loose.select("g").distinct().collect()} >= {"big"} and loose.count() < 1000 + 300
    assert written[2].count() < 4000


class Scans:
    """Upstream rows, counted each time they are computed."""

    def __init__(self, spark, rows):
        self.hits = spark.sparkContext.accumulator(0)
        hits = self.hits

        def pass_on(batches):
            for b in batches:
                hits.add(b.num_rows)
                yield b

        schema = "env string, row_key string, actual double, pred double"
        source = spark.createDataFrame([(f"e{i % 3}", f"k{i}", float(i % 11), float(i % 7)) for i in range(rows)], schema)
        self.df = source.mapInArrow(pass_on, schema)


@pytest.mark.parametrize("split", [10**6, 20])
@pytest.mark.parametrize(
    "operator",
    [
        lambda d, s: R.env_spearman(d, split_rows=s),
        lambda d, s: R.spearman(d, split_rows=s),
        lambda d, s: R.ktau(d, split_rows=s),
        lambda d, s: R.tau_b(d, ["env"], split_rows=s),
        lambda d, s: R.rank_hinge(d, split_rows=s),
        lambda d, s: R.rank_consistency(d, "env", split_rows=s),
        lambda d, s: O.positions(d, ["env"], [F.col("row_key")], split_rows=s),
    ],
)
def test_the_input_is_computed_once(spark, operator, split):
    scans = Scans(spark, 90)
    operator(scans.df, split).collect()
    assert scans.hits.value == 90
