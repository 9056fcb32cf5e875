"""Readers and writers (S1–S8). Inputs are files that Spark writes from the shared tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import REGISTRY, query
from trialspark.catalog import effects as CE
from trialspark.catalog import features as CF
from trialspark.catalog import metrics as CM  # noqa: F401 - registers the scoreboards whose SQL is used below
from trialspark.catalog import stacking as CK
from trialspark.catalog.common import WITH_META, WITH_PRED, pred, q6, rounded, train_test
from trialspark.catalog.features import COV_NUM, SQL_SCALER, covariates
from trialspark.catalog.relations import CELL_SQL, cells
from trialspark.operators import effects as E
from trialspark.operators import features as T
from trialspark.operators import metrics as M
from trialspark.operators import stacking as K
from trialspark.operators import relations as R
from trialspark.schema import TrialSchema
from trialspark.shared import scratch_path
from trialspark.sources import logs as L
from trialspark.sources import predictions as SP
from trialspark.sources import trials as S

SCHEMA = TrialSchema(env_numeric=("l_quantity", "l_discount", "l_tax"), env_categorical=("c_mktsegment",))


def written_trials(spark, sf):
    """Trial tables as CSV with a stray index column and some unparsable targets."""
    t = FX.trials(spark, sf)
    base = scratch_path(spark, "trials")
    x = t.select(F.monotonically_increasing_id().alias("Unnamed: 0"), F.col("row_key").alias("id"), "env", "l_quantity", "l_discount", "l_tax", "c_mktsegment")
    y = t.select(F.col("row_key").alias("id"), F.when(F.col("site") == 4, F.lit("n/a")).otherwise(F.col("yield_mg").cast("string")).alias("yield_mg"))
    x.write.option("header", True).csv(f"{base}/x")
    y.write.option("header", True).csv(f"{base}/y")
    return base


@query("s1_read_trials", "S1", WITH_META + f""", y as (select row_key, min(case when site <> 4 then yield_mg end) as y from trials group by row_key)
select env, count(*) as n, count(y) as n_target, {q6('sum(y)')} as total, {q6('sum(l_quantity)')} as quantity, 7 as n_columns from trials join y using (row_key) group by env""")
def _(spark, sf):
    base = written_trials(spark, sf)
    x, y = S.read_trials(spark, f"{base}/x", f"{base}/y", SCHEMA)
    xy = R.attach_target(x, y.groupBy("id").agg(F.min("yield_mg").alias("yield_mg")))
    return rounded(
        xy.groupBy("env").agg(
            F.count(F.lit(1)).alias("n"), F.count("yield_mg").alias("n_target"), F.sum("yield_mg").alias("total"), F.sum("l_quantity").alias("quantity"),
            F.lit(len(xy.columns)).alias("n_columns"),
        )
    )


@query("s2_pruned_read", "S2", WITH_META + "select env, count(distinct row_key) as n from trials group by env")
def _(spark, sf):
    base = written_trials(spark, sf)
    x, _ = S.read_trials(spark, f"{base}/x", None, SCHEMA, columns=["id", "env"])
    return x.groupBy("env").agg(F.count_distinct("id").alias("n"))


def written_predictions(spark, sf):
    """One CSV per model; m_b carries an explicit name, m_c an unsafe one."""
    c = cells(spark, sf)
    base = scratch_path(spark, "preds")
    names = {"m_b": "Model B", "m_c": "m?c"}
    for m in FX.MODELS:
        out = c.select(F.col("env").alias("Env"), "id", F.col("actual").alias("Actual"), F.col(m).alias("Pred"))
        if m in names:
            out = out.withColumns({"model_name": F.lit(names[m]), "checkpoint_dir": F.lit(f"run/{m}")})
        out.write.option("header", True).csv(f"{base}/{m}.csv")
    return base


@query("s3_read_predictions", "S3", WITH_PRED + CELL_SQL + ", l as (" + " union all ".join(
    f"select '{n}' as model, {d} as checkpoint_dir, env, actual, {m} as p from cell" for m, n, d in (("m_a", "m_a", "null"), ("m_b", "Model_B", "'run/m_b'"), ("m_c", "m_c", "'run/m_c'"), ("m_d", "m_d", "null"))
) + f") select model, checkpoint_dir, env, count(*) as n, {q6('avg(actual)', 9)} as actual, {q6('avg(p)', 9)} as pred from l group by all")
def _(spark, sf):
    base = written_predictions(spark, sf)
    long = SP.read_predictions(spark, [f"{base}/m_[ab].csv", f"{base}/m_c.csv", f"{base}/m_*.csv"])
    return rounded(long.groupBy("model", "checkpoint_dir", "env").agg(F.count(F.lit(1)).alias("n"), F.avg("actual").alias("actual"), F.avg("pred").alias("pred")), 9)


LOG_BASE = """with u as (select user_id, count(*) as n, round(avg(value), 2) as v, round(max(value), 2) as mx, round(min(value), 2) as mn, user_id % 4 as kind from events group by user_id)
"""


def written_logs(spark, sf):
    """Paths of one log file per user: header, CV summary, several test lines; kind 3 has no test lines."""
    e = FX.table(spark, sf, "events")
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("v"), F.round(F.max("value"), 2).alias("mx"), F.round(F.min("value"), 2).alias("mn"))
    kind = F.col("user_id") % 4
    uid = F.col("user_id").cast("string")
    tag = F.when(kind == 0, "baseline").when(kind == 1, F.concat(F.lit("drop0."), (F.col("user_id") % 10).cast("string"))).otherwise("tiny")

    def num(c):
        return F.format_string("%.2f", c.cast("double"))

    lines = [
        F.lit("starting"),
        F.when(kind == 0, F.concat(F.lit("export DROPOUT=0."), (F.col("user_id") % 7).cast("string"))).when(kind == 1, F.concat(F.lit("dropout (main) = 0."), (F.col("user_id") % 5).cast("string"))),
        F.concat(F.lit("cv/mean_val_env_avg_pearson: "), num(F.col("v"))),
        F.when(kind != 2, F.concat(F.lit("wandb: cv/mean_val_loss = "), num(F.col("mx")))),
        F.when(kind != 3, F.concat(F.lit("[TEST] fold_2021: env_avg_pearson="), num(F.col("mn")), F.lit(", weighted=0.1, mse="), num(F.col("mx")))),
        F.when(kind == 0, F.concat(F.lit("[TEST] best_fold: env_avg_pearson="), num(F.col("v")), F.lit(", mse="), num(F.col("n")))),
        F.when(kind != 3, F.concat(F.lit("[TEST] fold_2022: env_avg_pearson="), num(F.col("mx")), F.lit(", mse="), num(F.col("mn")))),
        F.when(kind != 3, F.concat(F.lit("[TEST] fold_2021: env_avg_pearson="), num(F.col("v")), F.lit(", mse="), num(F.col("mn")))),
        F.lit("done"),
    ]
    text = u.select(F.concat(F.lit("run-"), tag, F.lit("-"), uid).alias("job"), F.concat_ws("\n", *lines).alias("value"))
    return write_by_job(text, scratch_path(spark, "logs"))


def write_by_job(text, base: str) -> str:
    """One text file per row of ``job, value``; returns the paths to read.

    Spark's writer makes a folder per job, renames it and sets modes file by file; in a folder that tasks can
    open, they write the files themselves, all in one folder. A task that runs again writes the same files.
    """
    spark = text.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        text.write.partitionBy("job").text(base)
        return f"{base}/*/*.txt"
    fs.mkdirs(where)
    folder = where.toUri().getPath()

    def write(batches):
        n = 0
        for batch in batches:
            for job, value in zip(batch["job"].to_pylist(), batch["value"].to_pylist(), strict=True):
                with open(f"{folder}/job={job or '__HIVE_DEFAULT_PARTITION__'}.txt", "w", encoding="utf-8", newline="") as f:
                    f.write(f"{value}\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    text.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return base


def _user(df):
    return df.withColumn("user_id", F.regexp_extract("log_file", r"/job=run-[^/]*-(\d+)(?:\.txt|/[^/]*)$", 1).cast("long")).drop("log_file")


@query("s4_parse_run_logs", "S4", LOG_BASE + """select user_id, case when kind = 0 then 'baseline' when kind = 1 then concat('drop0.', user_id % 10) else 'tiny' end as tag,
case when kind = 0 then (concat('0.', user_id % 7))::double when kind = 1 then (concat('0.', user_id % 5))::double end as dropout, v as cv_val_pcc, case when kind <> 2 then mx end as cv_val_loss,
case when kind = 0 then v else mn end as test_pcc, case when kind = 0 then n::double else mx end as test_mse from u where kind <> 3""")
def _(spark, sf):
    return _user(L.parse_run_logs(spark, [written_logs(spark, sf)]))


@query("s4_fold_scores", "S4", LOG_BASE + "select user_id, '2021' as fold, v as test_pcc from u where kind <> 3 union all select user_id, '2022', mx from u where kind <> 3")
def _(spark, sf):
    return _user(L.parse_fold_scores(spark, [written_logs(spark, sf)]))


@query("s5_best_epoch", "S5", """with e as (select user_id, row_number() over (partition by user_id order by ts, event_id)::double as epoch, -value as val_loss, event_type from events)
select arg_min(epoch, (val_loss, epoch)) as best_epoch, min(val_loss) as best_val_loss, count(*) as n_epochs from e where event_type <> 'error'""")
def _(spark, sf):
    log = metric_log(spark, sf)
    path = scratch_path(spark, "epochs")
    loss = F.when(F.col("event_type") == "error", F.lit("nan")).otherwise(F.col("val_loss").cast("string"))
    log.select("epoch", F.col("val_pcc").alias("train_loss"), loss.alias("val_loss")).write.option("header", True).csv(path)
    return L.best_epoch(L.read_epoch_log(spark, path))


def metric_log(spark, sf):
    """Per-user metric log: epoch number, correlation, loss."""
    from trialspark.operators import ordering as O

    e = FX.table(spark, sf, "events")
    numbered = O.positions(e, ["user_id"], [F.col("ts"), F.col("event_id")], "epoch")
    return numbered.select(F.col("user_id").alias("run_id"), "epoch", (F.col("value") / 1000).alias("val_pcc"), (-F.col("value")).alias("val_loss"), "event_type", "event_id")


RUNS = """with u as (select user_id, count(*) as n, round(avg(value), 3) as v, round(max(value), 3) as mx, min(ts) as created, user_id % 5 as kind from events group by user_id)
"""


def written_runs(spark, sf):
    e = FX.table(spark, sf, "events")
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("v"), F.round(F.max("value"), 3).alias("mx"), F.min("ts").alias("created"))
    kind, uid = F.col("user_id") % 5, F.col("user_id").cast("string")
    config = F.map_from_arrays(F.array(F.lit("sweep_tag"), F.lit("dropout"), F.lit("emb_size")), F.array(F.when(kind == 0, F.concat(F.lit("cfg"), uid)).otherwise(""), F.lit("0.25"), F.col("n").cast("string")))
    name = F.when(kind == 1, F.concat(F.lit("x sweep+s"), uid, F.lit(" y"))).when(kind == 2, F.concat(F.lit("plain"), uid)).when(kind == 3, F.lit("")).otherwise(F.concat(F.lit("n"), uid))
    summary = F.map_from_arrays(
        F.array(F.lit("cv/mean_val_env_avg_pearson"), F.lit("test/env_avg_pearson"), F.lit("rolling/test/fold_2016/env_avg_pearson"), F.lit("rolling/test/fold_2023/env_avg_pearson")),
        F.array("v", "mx", F.col("v") + 1, F.when(kind == 2, F.col("mx"))),
    )
    runs = u.select(F.concat(F.lit("r"), uid).alias("id"), name.alias("name"), F.when(kind == 4, "crashed").otherwise("finished").alias("state"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("group"), F.col("created").alias("created_at"), config.alias("config"), summary.alias("summary"))
    path = scratch_path(spark, "runs")
    runs.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path


@query("s6_normalize_runs", "S6", RUNS + """select concat('r', user_id) as run_id, case when kind = 1 then concat('s', user_id) when kind = 2 then concat('plain', user_id) when kind = 3 then concat('r', user_id) else concat('cfg', user_id) end as tag,
0.25::double as dropout, cast(n as integer) as emb_size, '' as g_encoder_type, v as cv_val_pcc, cast(null as double) as cv_val_std, mx as test_pcc from u where kind <> 4 and user_id % 2 = 0""")
def _(spark, sf):
    runs = L.read_run_exports(spark, written_runs(spark, sf))
    return L.normalize_runs(runs, "even").select("run_id", "tag", "dropout", "emb_size", "g_encoder_type", "cv_val_pcc", "cv_val_std", "test_pcc")


@query("s6_run_fold_scores", "S6", RUNS + f"select concat('r', user_id) as run_id, 2016 as fold_year, {q6('v + 1')} as test_pcc from u where kind <> 4 union all select concat('r', user_id), 2023, {q6('mx')} from u where kind = 2")
def _(spark, sf):
    return rounded(L.run_fold_scores(L.read_run_exports(spark, written_runs(spark, sf))))


@query("s7_write_report", "S7", WITH_PRED + """select 'predictions' as report, count(*) as n from pred union all select 'env_metrics', count(distinct env) from pred union all select 'tester_metrics', count(distinct parent2) from pred
union all select 'run_metrics', 1 union all select 'yield_by_location', count(distinct location) from pred""")
def _(spark, sf):
    df = pred(spark, sf)
    tables = {
        "predictions": df.select("env", "id", "hybrid", "parent1", "parent2", "actual", "pred", "rank_pred"),
        "env_metrics": M.split_metrics(df, "env"),
        "tester_metrics": M.tester_metrics(df),
        "run_metrics": M.run_metrics(df),
        "yield_by_location": df.groupBy("location").agg(F.avg("pred").alias("mean_pred")),
    }
    out = scratch_path(spark, "report")
    paths = S.write_report(tables, out)
    return R.union_results([spark.read.parquet(p).agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("n")) for n, p in zip(tables, paths)])


@query("s8_fitted_state", "S8", SQL_SCALER + f"select feature, {q6('mean')} as mean, {q6('case when std = 0 then 1 else std end')} as scale from f")
def _(spark, sf):
    fitted = T.fit_scaler(covariates(spark, sf).filter(~F.col("env").endswith("_2001")), COV_NUM)
    path = scratch_path(spark, "state")
    S.save_params({"scaler": fitted}, path)
    back = S.load_params(spark, path, ["scaler"], {"scaler": ("feature", COV_NUM)})["scaler"]
    return rounded(back.select("feature", "mean", "scale"))


def reported(spark, name, table, fmt="parquet"):
    """``table`` written as a report and read back."""
    (path,) = S.write_report({name: table}, scratch_path(spark, "report"), fmt)
    reader = spark.read.schema(table.schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


@query("s7_env_pcc_report", "S7", REGISTRY["m13_env_pcc_report"].oracle)
def _(spark, sf):
    return rounded(reported(spark, "env_pcc", M.env_pcc_report(pred(spark, sf), pred="m_a"), "csv"))


@query("s7_novelty_report", "S7", REGISTRY["m11_novelty_metrics"].oracle)
def _(spark, sf):
    train, test = train_test(pred(spark, sf))
    return rounded(reported(spark, "novelty_metrics", M.novelty_metrics(test, train), "orc"))


@query("s7_tester_report", "S7", REGISTRY["m12_tester_metrics"].oracle)
def _(spark, sf):
    return rounded(reported(spark, "tester_metrics", M.tester_metrics(pred(spark, sf)), "json"))


@query("s7_stack_weights", "S7", REGISTRY["k5_weights_report"].oracle)
def _(spark, sf):
    best = K.search_weights(K.stack_moments(CK.wide(spark, sf, False), CK.MODELS), CK.MODELS, CK.N_RANDOM)
    return rounded(reported(spark, "stack_weights", K.stack_weights_report(best, CK.MODELS), "csv"))


@query("s7_stacked_predictions", "S7", REGISTRY["k4_apply_stack"].oracle)
def _(spark, sf):
    best = K.search_weights(K.stack_moments(CK.wide(spark, sf, False), CK.MODELS), CK.MODELS, CK.N_RANDOM)
    return rounded(reported(spark, "stacked_predictions", K.apply_stack(CK.wide(spark, sf, True), CK.MODELS, best), "csv"), 9)


def reloaded(spark, tables, expect=None):
    """Fitted tables saved and loaded again, with their key lists checked."""
    path = scratch_path(spark, "state")
    S.save_params(tables, path)
    return S.load_params(spark, path, list(tables), expect)


@query("s8_label_scalers", "S8", REGISTRY["t6_label_scalers"].oracle)
def _(spark, sf):
    train, _ = train_test(FX.meta_trials(spark, sf))
    return rounded(reloaded(spark, {"labels": T.fit_label_scalers(E.env_residuals(train))}, {"labels": ("label", ["total", "ymean", "resid"])})["labels"])


@query("s8_marker_stats", "S8", REGISTRY["t5_marker_standardise"].oracle)
def _(spark, sf):
    """Markers standardised with stats that were fitted, saved, checked against the columns in use and loaded."""
    m = FX.markers(spark, sf)
    columns = list(range(m.select(F.size("markers")).first()[0]))
    stats = reloaded(spark, {"markers": T.fit_marker_stats(m.filter("vec_id % 5 <> 0"))}, {"markers": ("marker", columns)})["markers"]
    return rounded(T.apply_marker_stats(m, stats).select("vec_id", F.posexplode("z").alias("marker", "z")))


@query("s8_parent_vocab", "S8", REGISTRY["t9_parent_ids"].oracle)
def _(spark, sf):
    t = CF._gappy_parents(spark, sf)
    vocab = reloaded(spark, {"parents": T.fit_parent_vocab(t.filter("year <= 1999"))})["parents"]
    return T.apply_parent_vocab(t, vocab).select("row_key", "parent1_id", "parent2_id")


@query("s8_effects", "S8", REGISTRY["e2_interaction_residual"].oracle)
def _(spark, sf):
    """Residuals by effects that were fitted, saved and loaded."""
    t, f = CE.fit(spark, sf)
    names = ["mu", "year_effect", "hybrid_effect", "env_effect"]
    back = reloaded(spark, {n: getattr(f, n) for n in names})
    loaded = E.Effects(*[back[n] for n in names])
    return rounded(E.interaction_residual(t.filter("year <= 1999"), loaded).select("row_key", "ge"))
