"""Edge rules on literal rows: parsing, undefined metrics, splits and their invariants."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from trialspark.functions import expressions as X
from trialspark.operators import batches as B
from trialspark.operators import effects as E
from trialspark.operators import features as T
from trialspark.operators import metrics as M
from trialspark.operators import ordering as O
from trialspark.operators import population as P
from trialspark.operators import relations as R
from trialspark.operators import selection as V
from trialspark.operators import splits as D
from trialspark.schema import TrialError, TrialSchema

NAN, INF = float("nan"), float("inf")


def one(df):
    return tuple(df.first())


# -- parsing -----------------------------------------------------------------------------

def test_name_parsing(spark):
    ids = ["L_2019-A/B", "L_2019-A/B/C", "L_2019-A", "A / B", "x-y-z/w", ""]
    df = X.split_parents(spark.createDataFrame([(i,) for i in ids], "id string").withColumn("hybrid", X.hybrid_name("id")))
    got = [tuple(r)[1:] for r in df.collect()]
    assert got == [("A/B", "A", "B"), ("A/B/C", "A", "B/C"), ("A", "A", ""), ("A / B", "A", "B"), ("y-z/w", "y-z", "w"), ("", "", "")]


def test_strict_year_raises_and_lenient_year_is_null(spark):
    df = spark.createDataFrame([("LOC_2019 ",), ("LOC",)], "env string")
    assert [r[0] for r in df.select(X.env_year("env", "null")).collect()] == [2019, None]
    assert [r[0] for r in df.select(X.env_year_lenient("env")).collect()] == [2019, None]
    with pytest.raises(Exception, match="no trailing year"):
        df.select(X.env_year("env")).collect()


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("abc",), ("",), ("nan",), (None,)], "v string")
    assert [r[0] for r in X.coerce_numeric(df, ["v"]).collect()] == [1.5, 2.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in X.coerce_numeric(df, ["v"], None).collect()] == [1.5, 2.0, None, None, None, None]


def test_softplus_does_not_overflow(spark):
    got = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "a double").select(X.softplus("a")).collect()]
    assert got == pytest.approx([0.0, math.log(2), 800.0])


# -- metrics -----------------------------------------------------------------------------

def scored(spark, rows):
    rows = [(e, f"k{i}", a, p) for i, (e, a, p) in enumerate(rows)]
    return spark.createDataFrame(rows, "env string, row_key string, actual double, pred double")


def test_undefined_correlations_are_null(spark):
    df = scored(spark, [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flatp", 1.0, 2.0), ("flatp", 2.0, 2.0),
                        ("bad", NAN, 1.0), ("bad", 1.0, INF), ("bad", None, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("near", 1e6, 1.0), ("near", 1e6 + 1, 2.0)])
    got = {r["env"]: (r["n"], r["pcc"]) for r in M.safe_pcc(df).collect()}
    assert got["one"] == (1, None) and got["flat"] == (2, None) and got["flatp"] == (2, None) and got["bad"] == (0, None)
    assert got["ok"] == (2, pytest.approx(1.0))
    assert got["near"] == (2, None)  # relative spread below the tolerance
    fit = {r["env"]: (r["slope"], r["intercept"]) for r in M.scale_fit(df).collect()}
    assert fit["flat"] == (None, None) and fit["ok"] == pytest.approx((2.0, 0.0)) and fit["flatp"] == pytest.approx((0.0, 2.0))


def test_macro_pcc_of_nothing_is_null(spark):
    df = scored(spark, [("a", 1.0, 1.0), ("b", 2.0, 2.0)])
    assert one(M.macro_env_pcc(df)) == (0, None)
    assert one(M.macro_env_mse(df, 2)) == (0, None) and one(M.macro_env_mse(df, 2, True)) == (0, 0.0)
    assert one(M.envpcc_loss(df))[1] == pytest.approx(0.0)  # falls back to all rows together
    assert one(M.envpcc_loss(df.limit(0)))[1] == 1.0
    assert one(M.env_level_pcc(df, "actual", "pred")) == (2, None)


def test_positive_scale_and_shift_keep_macro_pcc(spark):
    # three environments of different sizes, each with a line of its own
    lines = {"wet": (0.25, 11.0), "dry": (7.0, 0.0), "late": (1.0, -40.0)}
    rows = [(e, float((3 * i + len(e)) % 7), float((5 * i) % 6) / 3) for e, n in (("wet", 5), ("dry", 8), ("late", 11)) for i in range(n)]
    moved = [(e, t, lines[e][0] * p + lines[e][1]) for e, t, p in rows]
    a, b = (M.macro_env_pcc(scored(spark, r)).first() for r in (rows, moved))
    assert a["macro_pcc"] == pytest.approx(b["macro_pcc"]) and abs(a["macro_pcc"]) < 1
    flipped = [(e, t, -p) for e, t, p in rows]
    assert M.macro_env_pcc(scored(spark, flipped)).first()["macro_pcc"] == pytest.approx(-a["macro_pcc"])


def test_env_affine_keeps_order_inside_environments(spark):
    preds = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)], "env string, rank_pred double")
    params = spark.createDataFrame([("a", -30.0, 5.0), ("b", 3.0, -2.0)], "env string, a_env double, b_env double")
    rows = X.apply_env_affine(preds, params).orderBy("env", "rank_pred").collect()
    assert rows[0]["total_pred"] < rows[1]["total_pred"] and rows[2]["total_pred"] < rows[3]["total_pred"]


def test_null_group_keeps_its_row(spark):
    df = scored(spark, [("a", 1.0, 2.0), ("a", 3.0, 3.0), (None, 1.0, 1.0), (None, 2.0, 5.0)]).withColumn("rank_pred", F.col("pred"))
    assert {r["env"] for r in M.split_metrics(df, "env").collect()} == {"a", None}


def test_composite_errors(spark):
    df = scored(spark, [("a", 1.0, 2.0), ("a", 3.0, 3.0)])
    with pytest.raises(TrialError, match="weights"):
        M.composite_score(df, "mse+pcc", "1")
    with pytest.raises(TrialError, match="unknown or unimplemented"):
        M.composite_score(df, "mse+xi")
    total = {r["term"]: r["weighted"] for r in M.composite_score(df, " MSE + ktau ", "2,1").collect()}
    assert total["total"] == pytest.approx(total["mse"] + total["ktau"])


def test_run_metrics_equal_separate_metrics(spark):
    df = scored(spark, [("a", float(i % 7), float(i % 5)) for i in range(40)] + [("b", float(i % 4), float(i % 3)) for i in range(17)] + [("c", 1.0, 1.0)])
    df = df.withColumn("rank_pred", F.col("pred") * 2 + F.col("actual"))
    run = M.run_metrics(df).first()
    assert run["global_pcc"] == pytest.approx(M.global_pcc(df).first()["pcc"])
    assert run["global_mse"] == pytest.approx(M.mse(df).first()["mse"])
    assert run["env_pcc"] == pytest.approx(M.macro_env_pcc(df).first()["macro_pcc"])
    line = M.scale_fit(df.withColumn("g", F.lit(1)), "g", pred="rank_pred").first()
    assert (run["rank_slope"], run["rank_intercept"]) == pytest.approx((line["slope"], line["intercept"]))


# -- features ----------------------------------------------------------------------------

def test_scaler_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, "2")], "a double, b double, c string")
    fit = {r["feature"]: r for r in T.fit_scaler(df, ["a", "b", "c"]).collect()}
    assert (fit["a"]["mean"], fit["a"]["std"]) == pytest.approx((2.0, 1.0))
    assert (fit["b"]["std"], fit["b"]["scale"]) == (0.0, 1.0) and fit["c"]["mean"] == 1.0
    with pytest.raises(TrialError, match="fitted"):
        T.apply_scaler(df, None, ["a"])
    single = T.fit_scaler(df.limit(1), ["a"]).first()
    assert (single["std"], single["scale"]) == (0.0, 1.0)


def test_scaler_takes_wide_tables(spark):
    cols = [f"env_{i:03d}" for i in range(705)]
    df = spark.range(6).select(*[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(cols)])
    fit = T.fit_scaler(df, cols)
    assert fit.count() == 705
    out = T.apply_scaler(df, fit, cols).agg(F.avg("env_704").alias("m"), F.stddev_pop("env_704").alias("s")).first()
    assert (out["m"], out["s"]) == pytest.approx((0.0, 1.0), abs=1e-9)


def test_invalid_markers_become_zero(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5],), ([0.0, 1.0, 1.0],)], "markers array<double>")
    stats = {r["marker"]: (r["p"], r["valid"], r["scale"]) for r in T.fit_marker_stats(df).collect()}
    assert stats[0] == (0.0, False, 1.0) and stats[1] == (1.0, False, 1.0) and stats[2][1]
    z = [r["z"] for r in T.apply_marker_stats(df, T.fit_marker_stats(df)).collect()]
    assert all(v[0] == 0 and v[1] == 0 for v in z) and z[0][2] == pytest.approx(-z[1][2])


def test_large_vocabularies_join_by_id(spark):
    train = spark.range(5000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("soil"), (F.col("id") % 3).cast("string").alias("water"))
    vocab = T.fit_onehot(train, ["soil", "water"])
    rows = spark.createDataFrame([(1, "v7", "2"), (2, "v4999", "none such"), (3, None, "0")], "k int, soil string, water string")
    got = {r["k"]: r["onehot"] for r in T.onehot_ids(rows, vocab, ["soil", "water"]).collect()}
    ids = {(r["column"], r["value"]): i for i, r in enumerate(vocab.orderBy("column", "value").collect())}
    assert len(ids) == 5003
    assert got == {1: [ids["soil", "v7"], ids["water", "2"]], 2: [ids["soil", "v4999"]], 3: [ids["water", "0"]]}


def test_parent_vocab_numbering(spark):
    full = spark.createDataFrame([("B", "A")], "parent1 string, parent2 string")
    gap = spark.createDataFrame([("B", "A"), ("C", "")], "parent1 string, parent2 string")
    ids = lambda d: {r["parent"]: r["parent_id"] for r in T.fit_parent_vocab(d).collect()}
    assert ids(full) == {"A": 1, "B": 2} and ids(gap) == {"A": 2, "B": 3, "C": 4}
    unseen = T.apply_parent_vocab(spark.createDataFrame([("Z", "")], "parent1 string, parent2 string"), T.fit_parent_vocab(gap))
    assert (unseen.first()["parent1_id"], unseen.first()["parent2_id"]) == (0, 0)


def test_modes_and_alignment(spark):
    df = spark.createDataFrame([("e", 1.0, "yes")], "env string, x double, Irrigated string")
    assert T.preprocess_env(df, "off").columns == ["env", "x"]
    assert T.preprocess_env(df, "OHE").columns == ["env", "x", "Irrigated=yes"]
    with pytest.raises(TrialError):
        T.preprocess_env(df, "maybe")
    assert one(T.align_schema(df.drop("Irrigated"), ["y", "x"], ["env"])) == ("e", 0.0, 1.0)
    with pytest.raises(TrialError, match="expected 3"):
        T.align_schema(df, None, ["env"], 3)
    with pytest.raises(TrialError, match="required"):
        R.feature_view(df, TrialSchema(env_numeric=("nope",)))


# -- effects -----------------------------------------------------------------------------

def plots(spark, rows):
    return spark.createDataFrame(rows, "env string, year int, hybrid string, parent1 string, parent2 string, yield_mg double")


def test_effect_rules(spark):
    df = plots(spark, [("L_2019", 2019, "A/T", "A", "T", 1.0), ("L_2019", 2019, "B/T", "B", "T", 3.0), ("M_2020", 2020, "A/T", "A", "T", 6.0), ("M_2020", 2020, "B/T", "B", "T", None)])
    with pytest.raises(TrialError, match="exactly one"):
        E.fit_effects(df)
    with pytest.raises(Exception, match="no rows to fit"):
        E.fit_effects(df, train_max=1900).mu.collect()
    e = E.fit_effects(df, train_max=2019)
    new = plots(spark, [("N_2021", 2021, "C/T", "C", "T", 5.0)])
    r = E.attach_effects(new, e).first()
    assert (r["mu_year"], r["g_hat"], r["e_hat"], r["has_g_hat"], r["has_e_hat"], r["ge_hat"]) == (2.0, 0.0, 0.0, False, False, 3.0)


# -- splits ------------------------------------------------------------------------------

def held_out_year(spark):
    """Crosses of three seasons; the last one has new and known parents with wanted and other testers."""
    known = [f"K{i}" for i in range(4)]
    crosses = [(y, f"site{j}", p, t) for y in (2010, 2011) for j in range(3) for p in known for t in ("TA", "TB", "TC")]
    fresh = [(2012, "site0", f"F{i}", "TA") for i in range(6)] + [(2012, "site2", f"F{i}", "TB") for i in range(7)]
    kept_out = [(2012, "site0", "K1", "TA"), (2012, "site2", "F0", "TC"), (2012, "site2", "K3", "TC")]
    rows = [(f"{s}_{y}-{p}/{t}", f"{s}_{y}") for y, s, p, t in crosses + fresh + kept_out]
    return X.ensure_meta(spark.createDataFrame(rows, "id string, env string")), len(crosses), len(fresh), {f"{s}_{y}-{p}/{t}" for y, s, p, t in kept_out}


def test_held_out_year(spark):
    df, n_train, n_val, outside = held_out_year(spark)
    s = D.split_lygo(df, 2012, ["TA", "TB"])
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": n_train, "val": n_val, None: len(outside)}
    assert {r["id"] for r in s.filter("split is null").collect()} == outside
    info = D.lygo_diagnostics(df, 2012, ["TA", "TB"], test_tester_names=["TB", "TA", "TD"]).first()
    assert (info["n_val_rows"], info["n_val_envs"], info["overlap_parents"], info["testers_missing"]) == (n_val, 2, 0, "TD")
    assert info["warnings"] == "few_rows,few_envs"
    with pytest.raises(TrialError):
        D.split_lygo(df, 2012, ["TA"], novelty="tester")



def test_leo_has_no_environment_overlap(spark):
    df = held_out_year(spark)[0]
    s = D.split_leo(df, frac=0.5, test_year=2012)
    assert {r["key"]: r["n_shared"] for r in D.audit_split(s, ["env"]).collect()} == {"env": 0}
    assert s.filter("split = 'val'").select("env").distinct().count() == 3  # half of six
    assert D.leo_val_envs(df, 0.001, test_year=2012).count() == 1


def test_proxy_split_is_disjoint(spark):
    df = held_out_year(spark)[0]
    leo = D.leo_val_envs(df, 0.3, test_year=2013)
    s = D.split_proxy_tester(df, "TB", 0.4, leo_envs=leo, test_year=2013)
    val = s.filter("split = 'val'")
    assert val.join(leo, "env", "left_semi").count() == 0 and val.filter("parent2 <> 'TB'").count() == 0
    assert s.filter("split = 'excluded'").count() > 0
    held = val.select("parent1").distinct()
    assert s.filter("split = 'train' and parent2 = 'TB'").join(held, "parent1", "left_semi").count() == 0
    for frac in (0.0, 1.0):
        with pytest.raises(TrialError):
            D.split_proxy_tester(df, "TB", frac)
    with pytest.raises(TrialError, match="no rows"):
        D.split_proxy_tester(df, "NOBODY")


def test_fold_table_options(spark):
    years = lambda **k: [r["val_year"] for r in D.fold_table(spark, 2014, 2018, **k).orderBy("fold_idx").collect()]
    assert years() == [2015, 2016, 2017, 2018] and years(recent_first=True, max_folds=2) == [2018, 2017]
    assert years(val_years=[2017, 2016, 2016]) == [2016, 2017] and years(val_years=[2017], full=True) == [2015, 2016, 2017, 2018]
    assert years(single_year=2016, max_folds=1) == [2016] and years(max_folds=0) == [2015]
    with pytest.raises(TrialError):
        D.fold_table(spark, 2014, 2018, single_year=1990)
    with pytest.raises(TrialError):
        D.fold_table(spark, 2014, 2014)


# -- population --------------------------------------------------------------------------

def test_half_sibs_with_selfed_reciprocal_and_single_parents(spark):
    seen = ["A/B", "B/A", "A/A", "C", "C/D", "D/D", "E/F"]
    new = ["A/C", "B/B", "D", "X/Y", "C/A", "F/E", "A/D"]
    rows = [("L_2019", 2019, h) for h in seen] + [("L_2020", 2020, h) for h in new] + [("L_2020", 2020, "A/B")]
    df = X.split_parents(spark.createDataFrame(rows, "env string, year int, hybrid string"))
    got = {r["hybrid"]: r["n_half_sibs"] for r in P.half_sib_counts(df, 2020).collect()}
    parents = {h: {p for p in h.split("/")} for h in seen + new}
    want = {h: sum(bool(parents[h] & parents[s]) for s in seen) for h in new}
    assert got == want


def test_relation_errors(spark):
    x = spark.createDataFrame([("a", 1)], "id string, v int")
    y = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, y double")
    with pytest.raises(TrialError, match="repeats"):
        R.attach_target(x, y)
    with pytest.raises(TrialError):
        R.attach_target(x, y, "cross")
    with pytest.raises(TrialError):
        R.union_results([])
    assert R.filter_years(x.withColumn("env", F.lit("NOYEAR"))).count() == 1
    assert R.filter_years(x.withColumn("env", F.lit("NOYEAR")), 2000).count() == 0


def test_year_filter_searches_a_name_once(spark):
    """The year of a name that is itself worked out from the strict year isn't worked out again for each comparison."""
    df = X.ensure_meta(spark.range(10).select(F.concat(F.lit("L_"), (F.col("id") + 1995).cast("string")).alias("env"), F.lit("a-b/c").alias("id")))
    odd = df.withColumn("env20", F.concat("location", F.lit("_"), (F.col("year") + 20).cast("string")))
    years = lambda *bounds: sorted(r["year"] for r in R.filter_years(odd, *bounds, env="env20").select("year").collect())
    assert years(2017, 2019) == [1997, 1998, 1999]
    assert years(2017, 2017) == [1997]
    assert years(2019, 2017) == []
    assert years(2022, None) == [2002, 2003, 2004]
    assert years(None, 2016) == [1995, 1996]
    kept = R.filter_years(odd, 2017, 2019, "env20").select("year")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 3


# -- selection and batches ---------------------------------------------------------------

def test_few_pairs_give_no_verdict(spark):
    runs = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.2, 0.3), ("c", NAN, 0.1)], "run_id string, cv_val_pcc double, test_pcc double")
    assert one(V.cv_test_correlation(runs)) == (2, None, None, None, "INSUFFICIENT")
    assert one(V.cv_test_correlation(runs.limit(0))) == (0, None, None, None, "INSUFFICIENT")


def test_unknown_eval_mode(spark):
    folds = spark.createDataFrame([(0, 2015, 0.4, 1.0, "c")], "fold_idx int, val_year int, best_val_env_avg_pearson double, best_val_loss double, best_checkpoint string")
    with pytest.raises(TrialError):
        V.select_eval(folds, "sometimes")
    assert V.select_eval(folds, "year:2020").count() == 0 and V.select_eval(folds, "both").count() == 1


def test_promotion_rules(spark):
    rows = [("mean", p, 1.0) for p in (0.40, 0.41, 0.42)] + [("bar", 0.44, 1.0), ("bar", 0.45, 1.0)] + [("single", 0.44, 0.5)] + [("weak", 0.1, 0.1)] * 3
    got = {r["config"]: (r["promote_rank"], r["promote_scale"]) for r in V.promotion(spark.createDataFrame(rows, "config string, env_pcc double, env_mse double"), 0.40, 0.9, 0.44).collect()}
    assert got == {"mean": (True, False), "bar": (True, False), "single": (False, True), "weak": (False, False)}


@pytest.mark.parametrize("split", [10**6, 40])
def test_env_stratified_plan(spark, split):
    rows = [(f"r{i}", "hot" if i % 3 == 0 else f"e{i % 11}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_key string, env string")
    plan = B.env_stratified_plan(df, 32, 8, world=3, split_rows=split)
    sizes = plan.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("s")).collect()
    assert all(r["n"] == r["s"] <= 32 for r in sizes)
    assert len({r["rank"]: 0 for r in sizes}) == 3 and len(sizes) % 3 == 0
    per_chunk = plan.groupBy("rank", "step", "env").count().collect()
    assert all(r["count"] % 8 == 0 for r in per_chunk)
    with pytest.raises(TrialError):
        B.env_stratified_plan(df, 4, 8)


def test_mixed_plan_covers_the_epoch(spark):
    rows = [(f"r{i}", f"e{i % 7}") for i in range(200)]
    plan = B.mixed_env_plan(spark.createDataFrame(rows, "row_key string, env string"), 0.33, world=4, split_rows=30)
    got = {r["source"]: (r["n"], r["d"]) for r in plan.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("d")).collect()}
    assert got == {"env": (66, 66), "random": (134, 134)}
    assert sorted(r["count"] for r in plan.groupBy("rank").count().collect()) == [50, 50, 50, 50]


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.45, 1.0])
def test_mixed_plan_writes_its_rows_once(spark, monkeypatch, ratio):
    """Against brute force, with repeated and NULL keys and a NULL environment; intermediate tables don't hold the rows again and again."""
    rng = random.Random(5)
    rows = [(rng.choice([None, "twice", f"r{i}"]) if i % 9 == 0 else f"r{i}", rng.choice([None, "E1", "E2", "E3"]) if i % 4 else "E4") for i in range(900)]
    written = []
    for module in (B, O):
        monkeypatch.setattr(module, "materialize", lambda df, f=module.materialize: written.append((t := f(df)).count()) or t)
    got = B.mixed_env_plan(spark.createDataFrame(rows, "row_key string, env string"), ratio, world=3, split_rows=30).collect()

    def digest(*parts):
        return "" if None in parts else hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()  # NULL comes first

    def order(part, key):
        return digest(f"42/{part}", key), key or ""

    n_env = int(len(rows) * ratio)
    first, left = [], n_env
    for env in sorted({e for _, e in rows}, key=lambda e: order("env", e)):
        inside = sorted((k for k, e in rows if e == env), key=lambda k: order("row", k))[:max(0, left)]
        left -= sum(e == env for _, e in rows)
        first += [k for k in inside if env is not None]
    second = sorted((k for k, _ in rows), key=lambda k: order("random", k))[: len(rows) - n_env]
    mixed = sorted([(k, "env") for k in first] + [(k, "random") for k in second], key=lambda x: (digest("42/mix", x[1], x[0]), x[1], x[0] or ""))
    want = [(k, s, i % 3, i // 3) for i, (k, s) in enumerate(mixed)]
    assert sorted((r["step"], r["rank"], str(r["row_key"]), r["source"]) for r in got) == sorted((step, rank, str(k), s) for k, s, rank, step in want)
    assert sum(written) < 2.5 * len(rows)  # over four times before; frequent keys at a cut are written twice
