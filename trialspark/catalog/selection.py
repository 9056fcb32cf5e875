"""Fold and configuration selection queries (V1–V8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, WITH_PRED, pred, q6, r6, rounded
from trialspark.catalog.sequences import SQL_FOLDS, SQL_RUNS, fold_records, location_runs
from trialspark.operators import selection as V
from trialspark.operators import splits as D


@query("v1_fold_summary", "V1", SQL_FOLDS + f""", b as (select * from folds order by best_val_env_avg_pearson desc, best_val_loss limit 1), l as (select * from folds order by val_year desc limit 1)
select {q6('avg(best_val_loss)')} as mean_val_loss, {q6('stddev_pop(best_val_loss)')} as std_val_loss, {q6('avg(best_val_env_avg_pearson)')} as mean_val_pcc, {q6('stddev_pop(best_val_env_avg_pearson)')} as std_val_pcc,
(select val_year from b) as best_fold_year, {q6('(select best_val_env_avg_pearson from b)')} as best_fold_pcc, (select best_checkpoint from b) as best_fold_checkpoint, (select val_year from l) as latest_fold_year, (select best_checkpoint from l) as latest_fold_checkpoint from folds""")
def _(spark, sf):
    return rounded(V.fold_summary(fold_records(spark, sf)))


MODES = ["none", "best_fold", "latest_fold", "both", "all_folds", "year:1999", "year:1998"]


@query("v2_select_eval", "V2", SQL_FOLDS + """, t as (
 select 'best_fold' as mode, 'best_fold' as tag, 0 as o, * from (select * from folds order by best_val_env_avg_pearson desc, best_val_loss limit 1)
 union all select 'latest_fold', 'latest_fold', 1, * from (select * from folds order by val_year desc limit 1)
 union all select 'both', 'best_fold', 0, * from (select * from folds order by best_val_env_avg_pearson desc, best_val_loss limit 1)
 union all select 'both', 'latest_fold', 1, * from (select * from folds order by val_year desc limit 1)
 union all select 'all_folds', concat('fold_', val_year), val_year, * from folds
 union all select concat('year:', val_year), concat('fold_', val_year), 0, * from folds where val_year in (1998, 1999)),
 k as (select *, row_number() over (partition by mode, best_checkpoint order by o, fold_idx) as k from t where best_checkpoint <> '')
select mode, tag, fold_idx, val_year, best_checkpoint from k where k = 1""")
def _(spark, sf):
    folds = fold_records(spark, sf)
    parts = [V.select_eval(folds, m).select(F.lit(m).alias("mode"), "tag", "fold_idx", "val_year", "best_checkpoint") for m in MODES]
    return reduce(DataFrame.unionByName, parts)


@query("v3_primary_metrics", "V3", SQL_FOLDS + f"""select 'fold_1997' as wanted, 'fold_1997' as tag, val_year, {q6('best_val_env_avg_pearson')} as pcc from folds where val_year = 1997
union all select 'missing', concat('fold_', val_year), val_year, {q6('best_val_env_avg_pearson')} from folds where val_year = (select min(val_year) from folds)
union all select * from (select 'missing_but_best', 'best_fold', val_year, {q6('best_val_env_avg_pearson')} from folds order by best_val_env_avg_pearson desc, best_val_loss limit 1)""")
def _(spark, sf):
    folds = fold_records(spark, sf)
    evals = V.select_eval(folds, "all_folds")
    with_best = V.select_eval(folds, "both")
    cols = ["tag", "val_year", r6("best_val_env_avg_pearson").alias("pcc")]
    picks = [("fold_1997", V.primary_metrics(evals, "fold_1997")), ("missing", V.primary_metrics(evals, "nothing")), ("missing_but_best", V.primary_metrics(with_best, "nothing"))]
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("wanted"), *cols) for n, p in picks])


SEEDS = WITH_PRED.rstrip() + """, s as (select year as val_year, case when year = 1995 then 0 else site end as seed, regr_sxy(m_b,actual)/(sqrt(regr_sxx(m_b,actual))*sqrt(regr_syy(m_b,actual))) as r, avg(power(actual-m_b,2)) as e from pred group by all)
"""


def seed_records(spark, sf):
    df = pred(spark, sf).withColumn("site", F.when(F.col("year") == 1995, F.lit(0)).otherwise(F.col("site")))  # one seed only
    r = F.regr_sxy("m_b", "actual") / (F.sqrt(F.regr_sxx("m_b", "actual")) * F.sqrt(F.regr_syy("m_b", "actual")))
    d = F.col("actual") - F.col("m_b")
    return df.groupBy(F.col("year").alias("val_year"), F.col("site").alias("seed")).agg(r.alias("val_env_pcc"), F.avg(d * d).alias("mse"))


@query("v4_fold_seed_summary", "V4", SEEDS + f"select val_year, {q6('avg(r)')} as mean, {q6('coalesce(stddev_samp(r), 0)')} as std, count(*) as n from s group by grouping sets ((val_year), ())")
def _(spark, sf):
    return rounded(V.fold_seed_summary(seed_records(spark, sf)))


def _rho(score: str) -> str:
    return f"(select corr(a, b) from (select rank() over (order by {score}) as a, rank() over (order by test_pcc) as b from runs where {score} is not null and test_pcc is not null))"


@query("v5_selector_tracking", "V5", SQL_RUNS + f" select {q6(_rho('lygo_pcc'))} as lygo_pcc, {q6(_rho('leo_pcc'))} as leo_pcc, greatest(count(lygo_pcc + test_pcc), count(leo_pcc + test_pcc)) as n_runs, {_rho('lygo_pcc')} > {_rho('leo_pcc')} as first_beats_second from runs")
def _(spark, sf):
    return rounded(V.selector_tracking(location_runs(spark, sf)))


@query("v6_cv_test_correlation", "V6", SQL_RUNS + f""", ok as (select * from runs where cv_val_pcc is not null and test_pcc is not null),
pc as (select sum(sign(a.cv_val_pcc-b.cv_val_pcc)*sign(a.test_pcc-b.test_pcc)) as s, count(*) as n from ok a join ok b on a.run_id < b.run_id)
select count(*) as n_pairs, {q6(_rho('cv_val_pcc'))} as spearman, {q6('(select s::double/n from pc)')} as kendall, {q6('corr(cv_val_pcc, test_pcc)')} as pearson,
case when {_rho('cv_val_pcc')} >= 0.8 then 'STRONG' when {_rho('cv_val_pcc')} >= 0.5 then 'MODERATE' else 'WEAK' end as verdict from ok""")
def _(spark, sf):
    return rounded(V.cv_test_correlation(location_runs(spark, sf)))


@query("v7_promotion", "V7", SEEDS + f""", c as (select concat('site', seed) as config, count(*) as n_runs, avg(r) as mp, count(case when r > 0.43 then 1 end) as nb, avg(e) as me from s group by seed)
select config, n_runs, {q6('mp')} as mean_pcc, nb as n_above_bar, {q6('me')} as mean_mse, (n_runs >= 3 and mp >= 0.9::double + 0.003::double) or nb >= 2 as promote_rank,
me < (select avg(me) from c) and 0.892::double - mp <= 0.002::double as promote_scale from c""")
def _(spark, sf):
    runs = seed_records(spark, sf).select(F.concat(F.lit("site"), F.col("seed").cast("string")).alias("config"), F.col("val_env_pcc").alias("env_pcc"), F.col("mse").alias("env_mse"))
    base = runs.groupBy("config").agg(F.avg("env_mse").alias("m")).agg(F.avg("m").alias("base_mse"))  # one row
    return rounded(V.promotion(runs.join(F.broadcast(base)), 0.9, F.col("base_mse"), 0.892))


ROLL = """, f as (select * from (values (0, 1996, 1997), (1, 1997, 1998), (2, 1998, 1999), (3, 1999, 2000)) t(fold_idx, train_year_max, val_year)),
u as (select f.*, m.* from meta m join f on m.year <= train_year_max), mu as (select fold_idx, avg(yield_mg) as mu from u group by all),
yr as (select fold_idx, year, avg(yield_mg) as my from u group by all), g as (select fold_idx, hybrid, avg(yield_mg - my) as g from u join yr using (fold_idx, year) group by all),
e as (select u.fold_idx, u.env, avg(yield_mg) - max(my) - avg(g) as e from u join yr using (fold_idx, year) join g using (fold_idx, hybrid) group by all),
p as (select f.fold_idx, f.train_year_max, f.val_year, env, yield_mg, coalesce(my, mu) + coalesce(g, 0) + coalesce(e, 0) as pred from meta m join f on m.year = f.val_year join mu using (fold_idx)
 left join yr on yr.fold_idx = f.fold_idx and yr.year = m.year left join g on g.fold_idx = f.fold_idx and g.hybrid = m.hybrid left join e using (fold_idx, env)),
pm as (select fold_idx, train_year_max, val_year, env, count(*) as n, regr_sxx(pred, yield_mg) as saa, regr_syy(pred, yield_mg) as spp, regr_sxy(pred, yield_mg) as sap, sum(power(yield_mg-pred,2)) as sse from p group by all)"""


@query("v8_rolling_additive", "V8", WITH_META + ROLL + f""" select fold_idx, train_year_max, val_year, cast(sum(n) as bigint) as n_val, {q6('avg(case when n >= 2 and saa > 1e-8 and spp > 1e-8 then greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp)))) end)')} as env_pcc,
{q6('avg(case when n >= 2 then sse/n end)')} as env_mse, {q6('sum(sse)/sum(n)')} as mse from pm group by all""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    return rounded(V.rolling_fit_predict(t, D.fold_table(spark, 1996, 2000)))


RIDGE_X = ["l_quantity", "l_discount", "l_tax"]
_IX = range(3)
_M = [[f"(r{min(i, j)}{max(i, j)} + {1.0 if i == j else 0.0}::double)" for j in _IX] for i in _IX]


def _det(m) -> str:
    """Determinant of three rows of expressions."""
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


def _cramer(k: int) -> str:
    return f"{_det([[f'c{i}' if j == k else _M[i][j] for j in _IX] for i in _IX])}/{_det(_M)}"


RIDGE = """, f as (select * from (values (0, 1996, 1997), (1, 1997, 1998), (2, 1998, 1999), (3, 1999, 2000)) t(fold_idx, train_year_max, val_year)),
mo as (select f.*, avg(yield_mg) as my, """ + ", ".join(
    [f"avg({x}) as m{i}, stddev_pop({x}) as s{i}, covar_pop({x}, yield_mg) as v{i}" for i, x in enumerate(RIDGE_X)]
    + [f"covar_pop({RIDGE_X[i]}, {RIDGE_X[j]}) as k{i}{j}" for i in _IX for j in _IX if i <= j]
) + " from meta join f on year <= train_year_max group by all), st as (select *, " + ", ".join(
    [f"v{i}/s{i} as c{i}" for i in _IX] + [f"k{i}{j}/(s{i}*s{j}) as r{i}{j}" for i in _IX for j in _IX if i <= j]
) + " from mo), w as (select *, " + ", ".join(f"{_cramer(i)} as w{i}" for i in _IX) + """ from st),
p as (select fold_idx, train_year_max, val_year, env, yield_mg, my + """ + " + ".join(f"w{i}*({x} - m{i})/s{i}" for i, x in enumerate(RIDGE_X)) + """ as pred from meta join w on year = val_year),
pm as (select fold_idx, train_year_max, val_year, env, count(*) as n, regr_sxx(pred, yield_mg) as saa, regr_syy(pred, yield_mg) as spp, regr_sxy(pred, yield_mg) as sap, sum(power(yield_mg-pred,2)) as sse from p group by all)"""
ROLL_SCORES = f""" select fold_idx, train_year_max, val_year, cast(sum(n) as bigint) as n_val, {q6('avg(case when n >= 2 and saa > 1e-8 and spp > 1e-8 then greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp)))) end)')} as env_pcc,
{q6('avg(case when n >= 2 then sse/n end)')} as env_mse, {q6('sum(sse)/sum(n)')} as mse from pm group by all"""


@query("v8_rolling_ridge", "V8", WITH_META + RIDGE + ROLL_SCORES)
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    return rounded(V.rolling_ridge(t, D.fold_table(spark, 1996, 2000), RIDGE_X))
