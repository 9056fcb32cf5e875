"""Readers, writers, stacking rules, streaming and the workflows."""

import os
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark import plans
from trialspark import fixtures as FX
from trialspark.operators import metrics as M
from trialspark.operators import similarity as S
from trialspark.operators import stacking as K
from trialspark.operators import splits as D
from trialspark.schema import TrialError, TrialSchema
from trialspark.shared import materialize, scratch_path, shared_dir
from trialspark.sources import logs as L
from trialspark.sources import predictions as SP
from trialspark.sources import trials as T
from trialspark.streaming import env_metrics as ST


def test_shared_folder_is_one_per_session(spark):
    assert shared_dir(spark) == shared_dir(spark) and scratch_path(spark, "a") != scratch_path(spark, "a")


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("v", F.array("id"))
    back = materialize(df)
    assert back.dtypes == df.dtypes and sorted(r["id"] for r in back.collect()) == list(range(5))


def test_tables_of_many_small_partitions_are_written_in_few_files(spark):
    from trialspark.shared import FILES_PER_CORE, SHARE, gather, in_few_files

    most = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(3 * most)
    back = gather(many)
    assert 0 < len(back.inputFiles()) <= most and sorted(r["id"] for r in back.collect()) == list(range(1000))
    assert in_few_files(spark.range(10).repartition(2)).rdd.getNumPartitions() == 2
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", SHARE * 2 * most)
        assert in_few_files(many).rdd.getNumPartitions() == 2 * most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_trial_reader_rules(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Unnamed: 0,id,Env,m0\n0,a,E_2019,0.5\n1,b,E_2019,oops\n")
    (tmp_path / "y.csv").write_text("id,Yield\na,1.5\nb,\n")
    schema = TrialSchema(env="Env", target="Yield", markers=("m0",))
    x, y = T.read_trials(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), schema)
    assert x.columns == ["id", "Env", "m0"] and [r["m0"] for r in x.orderBy("id").collect()] == [0.5, None]
    assert [r["Yield"] for r in y.orderBy("id").collect()] == [1.5, None]
    with pytest.raises(TrialError, match="yield_mg"):
        T.read_target(spark, str(tmp_path / "y.csv"), TrialSchema())
    with pytest.raises(TrialError, match="env"):
        T.read_features(spark, str(tmp_path / "x.csv"), TrialSchema())


def test_stored_trials_prune_years_and_columns(spark, sf, tmp_path):
    path = T.store_trials(FX.trials(spark, sf), str(tmp_path / "store"))
    df = spark.read.parquet(path).filter("year <= 1996").select("env", "yield_mg")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<env:string,yield_mg:double>" in plan
    assert df.count() == FX.meta_trials(spark, sf).filter("year <= 1996").count()


def test_fitted_state_checks_its_columns(spark, tmp_path):
    fitted = spark.createDataFrame([("m0", 0.5), ("m1", 0.1)], "feature string, p double")
    T.save_params({"markers": fitted}, str(tmp_path))
    assert T.load_params(spark, str(tmp_path), ["markers"], {"markers": ("feature", ["m1", "m0"])})["markers"].count() == 2
    for wrong in (["m0"], ["m0", "m1", "m2"], ["m0", "mX"]):
        with pytest.raises(TrialError, match="differ"):
            T.load_params(spark, str(tmp_path), ["markers"], {"markers": ("feature", wrong)})


def test_prediction_files(spark, tmp_path):
    head = "Env,id,Actual,Pred"
    (tmp_path / "a.csv").write_text(f"{head}\nE_2019,1,1.0,2.0\nE_2019,2,2.0,3.0\n")
    (tmp_path / "b.csv").write_text("id,Env,Pred,Actual,model_name\n1,E_2019,5.0,1.0000001,a\n3,E_2019,9.0,1.0,a\n")
    long = SP.read_predictions(spark, [str(tmp_path / "*.csv")])
    wide = SP.merge_predictions(long)
    assert wide.columns == ["env", "id", "actual", "a", "a_2"] and [(r["id"], r["a"], r["a_2"]) for r in wide.collect()] == [("1", 2.0, 5.0)]
    with pytest.raises(TrialError, match="no file"):
        SP.read_predictions(spark, [str(tmp_path / "none*.csv")])
    (tmp_path / "c.csv").write_text("Env,id,Pred\nE,1,1\n")
    with pytest.raises(TrialError, match="Actual"):
        SP.read_predictions(spark, [str(tmp_path / "c.csv")])


def test_merge_errors(spark):
    cols = "env string, id string, actual double, pred double, model string"
    ok = [("e", "1", 1.0, 1.0, "a"), ("e", "1", 1.0, 2.0, "b")]
    assert SP.merge_predictions(spark.createDataFrame(ok, cols)).count() == 1
    for rows, text in (
        (ok + [("e", "1", 1.0, 3.0, "b")], "repeat"),
        ([ok[0], ("e", "1", 1.1, 2.0, "b")], "labels differ"),
        ([ok[0], ("e", "2", 1.0, 2.0, "b")], "no \\(env, id\\)"),
    ):
        with pytest.raises(TrialError, match=text):
            SP.merge_predictions(spark.createDataFrame(rows, cols))


def test_run_log_rules(spark, tmp_path):
    best = "[TEST] best_fold: env_avg_pearson=0.{} , mse=2.0\n"
    (tmp_path / "job-tiny-1.out").write_text("dropout_p = 0.3\n[TEST] fold_2021: env_avg_pearson=0.11, x, mse=1.5\n" + best.format(2) + best.format(3))
    (tmp_path / "plain.out").write_text("DROPOUT=0.25\ncv/mean_val_loss:\n  1.25\n[TEST] latest_fold: env_avg_pearson=0.4, mse=3\n[TEST] fold_2020: env_avg_pearson=0.5, mse=4\n")
    (tmp_path / "empty.out").write_text("nothing here\n")
    got = {r["tag"]: r for r in L.parse_run_logs(spark, [str(tmp_path / "*.out")]).collect()}
    assert set(got) == {"tiny", "plain"}
    assert (got["tiny"]["dropout"], got["tiny"]["test_pcc"], got["tiny"]["test_mse"]) == (0.3, 0.3, 2.0)
    assert (got["plain"]["dropout"], got["plain"]["cv_val_loss"], got["plain"]["test_pcc"]) == (0.25, 1.25, 0.4)
    folds = {(r["fold"], r["test_pcc"]) for r in L.parse_fold_scores(spark, [str(tmp_path / "*.out")]).collect()}
    assert folds == {("2021", 0.11), ("2020", 0.5)}


# -- stacking ----------------------------------------------------------------------------

def wide(spark, n=240):
    g = np.random.default_rng(11)
    rows = []
    for i in range(n):
        y = float(g.normal())
        rows.append((f"e{i % 6}", str(i), y, y + float(g.normal()), float(g.normal()), y * 0.5 + float(g.normal())))
    return spark.createDataFrame(rows, "env string, id string, actual double, a double, b double, c double")


def test_moments_score_equals_direct_metric(spark):
    df, models = wide(spark), ["a", "b", "c"]
    moments = K.stack_moments(df, models)
    best = K.search_weights(moments, models, 50).first()
    w = [best[f"w_{i}"] for i in range(3)]
    direct = M.macro_env_pcc(K.apply_stack(df, models, w)).first()["macro_pcc"]
    assert sum(w) == pytest.approx(1.0) and best["score"] == pytest.approx(direct)


def test_refinement_never_loses(spark):
    df, models = wide(spark), ["a", "b", "c"]
    moments = materialize(K.stack_moments(df, models))
    start = K.search_weights(moments, models, 20).first()
    w, score = K.refine_weights(moments, models, [start[f"w_{i}"] for i in range(3)], rounds=3, n_random=60)
    assert score >= start["score"] - 1e-12 and sum(w) == pytest.approx(1.0) and min(w) >= 0
    with pytest.raises(TrialError):
        K.refine_weights(moments, models, [1.0, 1.0, 0.0])


def test_model_order_must_match(spark):
    df = wide(spark)
    with pytest.raises(TrialError, match="same models"):
        K.stack_report(df, df, ["a", "b"], [0.5, 0.5], ["b", "a"])


# -- similarity --------------------------------------------------------------------------

@pytest.mark.parametrize("block", [3, 64])
def test_blocks_give_the_whole_matrix(spark, block):
    g = np.random.default_rng(2)
    d = g.integers(0, 3, (14, 9)).astype(float)
    d[:, 4] = 2.0  # a marker without variation
    df = spark.createDataFrame([(0, i, [float(x) for x in v]) for i, v in enumerate(d)], "batch int, vec_id int, dosage array<double>").repartition(4)
    got = {(r["i"], r["j"]): r["sim"] for r in S.ibs(df, block=block).collect()}
    assert set(got) == {(i, j) for i in range(14) for j in range(i, 14)}
    for (i, j), s in got.items():
        assert s == pytest.approx(1 - np.abs(d[i] - d[j]).mean() / 2)
    p = d.mean(0) / 2
    ok = (p > 1e-6) & (p < 1 - 1e-6)
    z = np.where(ok, (d - 2 * p) / np.sqrt(2 * p * (1 - p) + 1e-6), 0)
    want = z @ z.T / max(ok.sum(), 1)
    for r in S.grm(df, block=block).collect():
        assert r["sim"] == pytest.approx(want[r["i"], r["j"]])


def test_similarity_rules(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0], [1.0, 2.0])], "batch int, vec_id int, dosage array<double>, embedding array<double>")
    with pytest.raises(TrialError):
        S.env_similarity(df, "euclid", "vec_id", "embedding")
    assert tuple(S.alignment_score(df, "cosine", "mse").first()) == (0, 1, 0.0)
    with pytest.raises(TrialError):
        S.alignment_score(df, "grm", "hinge")
    sizes = [r["count"] for r in S.batched(spark.range(23), "id", 5).groupBy("batch").count().collect()]
    assert sorted(sizes) == [3, 5, 5, 5, 5]


# -- streaming ---------------------------------------------------------------------------

def test_stream_equals_batch_after_several_files(spark, tmp_path):
    rows = [(f"e{i % 5}", float((i * 37) % 101), float((i * 53) % 97)) for i in range(300)] + [("bad", float("nan"), 1.0), ("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "env string, actual double, pred double")
    out, ck, src = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "src")
    for part in range(3):  # files arrive in three deliveries, the job restarts in between
        df.filter(F.col("actual").isNull() | (F.abs(F.hash("actual", "pred")) % 3 == part)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        ST.stream_env_metrics(stream, out, ck).awaitTermination()
    got = {r["env"]: (r["n"], r["pcc"]) for r in ST.latest_metrics(spark, out).collect()}
    per = {r["env"]: (r["n"], r["r"]) for r in M.env_pcc(M.finite_pairs(df)).collect()}
    macro = got.pop(None)
    assert macro[1] == pytest.approx(M.macro_env_pcc(df).first()["macro_pcc"])
    assert set(got) == set(per)
    for e, (n, r) in per.items():
        assert got[e][0] == n and (r is None) == (got[e][1] is None) and (r is None or got[e][1] == pytest.approx(r))


# -- workflows ---------------------------------------------------------------------------

def test_workflows(spark, sf, tmp_path):
    scored = FX.predictions(FX.trials(spark, sf))
    meta = FX.meta_trials(spark, sf)
    tables = plans.evaluate(scored, meta.filter("year < 2001"), str(tmp_path / "eval"))
    assert tables["run_metrics"].first()["n"] == scored.count()
    assert spark.read.parquet(str(tmp_path / "eval" / "novelty_metrics")).count() == 2
    effects, reports = plans.decompose(FX.trials(spark, sf), leo_envs=D.leo_val_envs(meta, test_year=2001), test_year=2001)
    assert effects.env_effect.count() > 0 and reports["variance"].first()["n"] > 0
    cv = plans.rolling_cv(FX.trials(spark, sf), 1997, 2000, max_folds=2)
    assert cv["folds"].count() == 2 and cv["summary"].first()["latest_fold_year"] == 1999


def test_stack_workflow(spark, tmp_path):
    df = wide(spark).withColumn("env", F.concat("env", F.lit("_2019")))
    for m in ("a", "b"):
        df.select(F.col("env").alias("Env"), "id", F.col("actual").alias("Actual"), F.col(m).alias("Pred")).write.option("header", True).csv(str(tmp_path / f"{m}.csv"))
    out = plans.stack(spark, [str(tmp_path / "*.csv")], [str(tmp_path / "*.csv")], (2018, 2020), n_random=30, rounds=1, out_dir=str(tmp_path / "out"))
    report = {r["split"]: r for r in out["report"].collect()}
    assert report["train"]["n_rows"] == report["test"]["n_rows"] == 240
    assert out["weights"].first()["model"] == "a"


def test_scratch_deletes_intermediate_tables(spark):
    from trialspark.shared import materialize, scratch

    with scratch(spark):
        outer = materialize(spark.range(3))
        with scratch(spark):
            inner = materialize(outer)
            path = inner.inputFiles()[0]
            assert inner.count() == 3
        assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))
        assert outer.count() == 3
        path = outer.inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))


def folder(spark):
    from trialspark.shared import shared_dir

    return shared_dir(spark).removeprefix("file:").replace("//", "/")


def test_plans_leave_their_results_alone(spark, sf, tmp_path):
    trials = FX.trials(spark, sf)
    scored = FX.predictions(trials)
    before = set(os.listdir(folder(spark)))
    tables = plans.evaluate(scored, FX.meta_trials(spark, sf).filter("year < 2001"))
    effects, reports = plans.decompose(trials, train_max=1999)
    cv = plans.rolling_cv(trials, 1997, 2000)
    left = {n.rpartition("-")[0] for n in set(os.listdir(folder(spark))) - before}
    assert left == {*tables, *reports, "mu", "year_effect", "hybrid_effect", "env_effect", "scores"}
    values = [r["pcc"] for r in tables["env_pcc"].collect()]
    assert values == sorted(values, reverse=True) and cv["scores"].count() == 3 and effects.mu.count() == 1


def test_inner_blocks_end_while_both_are_empty(spark):
    from trialspark.shared import materialize, scratch

    with scratch(spark):
        with scratch(spark):
            pass
        path = materialize(spark.range(2)).inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))


def test_results_belong_to_the_block_outside(spark):
    from trialspark.shared import finished, materialize, scratch

    with scratch(spark):
        out = finished(spark, lambda: {"r": materialize(spark.range(5)).filter("id > 1")}, {"r": ["id"]})["r"]
        path = out.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert [r["id"] for r in out.collect()] == [2, 3, 4] and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_thousand_snapshots_leave_a_few_folders(spark, tmp_path):
    out = str(tmp_path / "out")
    row = spark.createDataFrame([(None, 1, 0.5, 1.0, 0)], "env string, n long, pcc double, mse double, epoch long")
    for epoch in range(40):
        ST.publish_snapshot(row, out, epoch, keep=3)
        assert len(os.listdir(out)) <= 6 + len([n for n in os.listdir(out) if n.startswith(".")])
    assert sorted(n for n in os.listdir(out) if n.startswith("snapshot=")) == ["snapshot=37", "snapshot=38", "snapshot=39"]
    os.makedirs(f"{out}/snapshot=99")  # begun, not committed
    assert ST.latest_metrics(spark, out).first()["pcc"] == 0.5
    with pytest.raises(TrialError):
        ST.stream_env_metrics(row, out, out, keep=1)


def test_a_reader_survives_expiry(spark, tmp_path):
    out = str(tmp_path / "out")

    def publish(epoch):
        ST.publish_snapshot(spark.createDataFrame([(None, epoch, 0.5, 1.0, 0)], "env string, n long, pcc double, mse double, epoch long"), out, epoch, keep=2)

    publish(0)
    seen = []

    def use(df):
        if not seen:
            for e in range(1, 6):  # the snapshot goes away before it is read
                publish(e)
        seen.append(1)
        return df.first()["n"]

    assert ST.read_latest(spark, out, use) == 5 and len(seen) == 2
    with pytest.raises(ValueError):
        ST.read_latest(spark, out, lambda df: int("x"))


def test_many_prediction_files_start_a_fixed_number_of_jobs(spark, tmp_path):
    def jobs(n):
        where = tmp_path / f"n{n}"
        where.mkdir()
        for i in range(n):
            head, row = ("Env,id,Actual,Pred", f"e,k{i},1.0,2.0") if i % 2 else ("id,extra,Pred,Actual,Env,model_name", f"k{i},x,2.0,1.0,e,M {i}")
            (where / f"f {i:03d}.csv").write_text(f"{head}\n{row}\n")
        sc = spark.sparkContext
        sc.setJobGroup(f"files{n}", "")
        long = SP.read_predictions(spark, [str(where / "*.csv")])
        rows = {(r["id"], r["model"], r["actual"], r["pred"]) for r in long.collect()}
        sc.setJobGroup("", "")
        assert rows == {(f"k{i}", f"f_{i:03d}" if i % 2 else f"M_{i}", 1.0, 2.0) for i in range(n)}
        return len(sc.statusTracker().getJobIdsForGroup(f"files{n}"))

    assert jobs(4) == jobs(60)


def test_a_large_log_is_read_in_splits(spark, tmp_path):
    noise = "".join(f"step {i} loss=0.{i}\n" for i in range(60000))
    text = "start DROPOUT=0.3\n" + noise + "cv/mean_val_env_avg_pearson\n  value -> 0.41 end\n[TEST] fold_2020: env_avg_pearson=0.1, mse=9\n" + noise
    text += "[TEST] best_fold: env_avg_pearson=0.2, mse=8\n" + noise + "[TEST] best_fold: env_avg_pearson=0.3, mse=7\n[TEST] fold_2020: env_avg_pearson=0.5, mse=6\ncv/mean_val_loss: 2.5\n"
    (tmp_path / "run-tiny-1.out").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        glob = [str(tmp_path / "*.out")]
        assert L.read_log_lines(spark, glob).rdd.getNumPartitions() > 4
        r = L.parse_run_logs(spark, glob).first()
        folds = [tuple(x)[1:] for x in L.parse_fold_scores(spark, glob).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (r["tag"], r["dropout"], r["cv_val_pcc"], r["cv_val_loss"], r["test_pcc"], r["test_mse"]) == ("tiny", 0.3, 0.41, 2.5, 0.3, 7.0)
    assert folds == [("2020", 0.5)]


def test_small_logs_are_opened_once(spark, tmp_path):
    """The files are read while the lines that tell something are written; the result reads these alone."""
    from trialspark.catalog.sources import _user, write_by_job

    jobs = [(f"run-tiny-{i}", f"start\nDROPOUT=0.{i % 5}\ncv/mean_val_loss: {i}.5\n[TEST] fold_2020: env_avg_pearson=0.25, mse={i}") for i in range(60)]
    where = write_by_job(spark.createDataFrame([*jobs, (None, "no test line")], "job string, value string"), scratch_path(spark, "logs"))
    assert len(spark.read.text([where]).select("_metadata.file_path").distinct().collect()) == 61
    parsed = _user(L.parse_run_logs(spark, [where]))
    assert "FileScan text" not in parsed._jdf.queryExecution().executedPlan().toString()
    got = {(r["user_id"], r["tag"], r["dropout"], r["cv_val_loss"], r["test_pcc"], r["test_mse"]) for r in parsed.collect()}
    assert got == {(i, "tiny", (i % 5) / 10, i + 0.5, 0.25, float(i)) for i in range(60)}
