"""Decomposition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, q6, rounded
from trialspark.operators import effects as E
from trialspark.operators import metrics as M
from trialspark.operators import relations as R

FIT = """, u as (select * from meta where year <= 1999), mu as (select avg(yield_mg) as mu from u),
yr as (select year, avg(yield_mg) as my from u group by year),
g as (select hybrid, avg(yield_mg - my) as g, count(*) as n from u join yr using (year) group by hybrid),
e as (select u.env, avg(yield_mg) - max(my) - avg(g) as e, count(*) as n from u join yr using (year) join g using (hybrid) group by u.env),
ge as (select u.*, my, g, e, yield_mg - my - g - e as ge from u join yr using (year) join g using (hybrid) join e using (env))"""


def fit(spark, sf):
    t = FX.meta_trials(spark, sf)
    return t, E.fit_effects(t, train_max=1999)


@query("e1_fit_effects", "E1", WITH_META + FIT + f""" select 'mu' as part, 'all' as key, {q6('mu')} as effect from mu union all select 'year', cast(year as varchar), {q6('my')} from yr
union all select 'hybrid', hybrid, {q6('g')} from g union all select 'env', env, {q6('e')} from e""")
def _(spark, sf):
    _, f = fit(spark, sf)
    parts = [
        f.mu.select(F.lit("mu").alias("part"), F.lit("all").alias("key"), F.col("mu").alias("effect")),
        f.year_effect.select(F.lit("year").alias("part"), F.col("year").cast("string").alias("key"), F.col("mu_year").alias("effect")),
        f.hybrid_effect.select(F.lit("hybrid").alias("part"), F.col("hybrid").alias("key"), F.col("g_hat").alias("effect")),
        f.env_effect.select(F.lit("env").alias("part"), F.col("env").alias("key"), F.col("e_hat").alias("effect")),
    ]
    return rounded(R.union_results(parts))


@query("e2_interaction_residual", "E2", WITH_META + FIT + f" select row_key, {q6('ge')} as ge from ge")
def _(spark, sf):
    t, f = fit(spark, sf)
    return rounded(E.interaction_residual(t.filter("year <= 1999"), f).select("row_key", "ge"))


@query("e3_variance_decomposition", "E3", WITH_META + FIT + f""", v as (select count(*) as n, var_samp(yield_mg) as t, var_samp(my) as y, var_samp(e) as e, var_samp(g) as g, var_samp(ge) as i from ge)
select n, {q6('t')} as var_total, {q6('y')} as var_year, {q6('e')} as var_env, {q6('g')} as var_hybrid, {q6('i')} as var_interaction, {q6('t-y-e-g-i')} as var_cross,
{q6('y/t')} as share_year, {q6('e/t')} as share_env, {q6('g/t')} as share_hybrid, {q6('i/t')} as share_interaction, {q6('(t-y-e-g-i)/t')} as share_cross from v""")
def _(spark, sf):
    t, f = fit(spark, sf)
    return rounded(E.variance_decomposition(E.interaction_residual(t.filter("year <= 1999"), f)))


@query("e4_hybrid_obs_profile", "E4", WITH_META + f""", h as (select hybrid, count(*) as n from meta group by hybrid)
select count(*) as n_hybrids, min(n) as min_obs, median(n)::double as median_obs, {q6('avg(n)')} as mean_obs, max(n) as max_obs, count(case when n = 1 then 1 end) as n_single,
count(case when n >= 3 then 1 end) as n_three_plus, count(case when n < 40 then 1 end) as n_below_min from h""")
def _(spark, sf):
    return rounded(E.hybrid_obs_profile(FX.meta_trials(spark, sf), 40))


@query("e5_tester_distribution", "E5", WITH_META + "select parent2, count(*) as n_rows, count(distinct hybrid) as n_hybrids from meta group by parent2 order by n_rows desc, parent2 limit 3")
def _(spark, sf):
    return E.tester_distribution(FX.meta_trials(spark, sf), 3)


@query("e6_heldout_coverage", "E6", WITH_META + FIT + f""", h as (select distinct hybrid from meta where year > 1999), v as (select distinct env from meta where year > 1999)
select 'hybrid' as part, count(*) as n_keys, count(case when g is null then 1 end) as n_missing, {q6('100.0*count(case when g is null then 1 end)/count(*)')} as pct_missing from h left join g using (hybrid)
union all select 'env', count(*), count(case when e is null then 1 end), {q6('100.0*count(case when e is null then 1 end)/count(*)')} from v left join e using (env)""")
def _(spark, sf):
    t, f = fit(spark, sf)
    return rounded(E.heldout_coverage(t.withColumn("seen", F.col("year") <= 1999), f, "seen"))


@query("e7_effect_stats", "E7", WITH_META + FIT + " union all ".join(
    f" select '{name}' as effect, count(*) as n, {q6(f'avg({c})')} as mean, {q6(f'stddev_pop({c})')} as std, {q6(f'min({c})')} as min, {q6(f'max({c})')} as max from {t}"
    for name, t, c in (("hybrid", "g", "g"), ("env", "e", "e"), ("year", "yr", "my"))))
def _(spark, sf):
    return rounded(E.effect_stats(fit(spark, sf)[1]))


@query("e8_additive_predict", "E8", WITH_META + FIT + f""", p as (select meta.*, coalesce(my, mu) + coalesce(g, 0) + coalesce(e, 0) as pred from meta left join yr using (year) left join g using (hybrid) left join e using (env), mu)
select row_key, {q6('pred')} as pred from p""")
def _(spark, sf):
    t, f = fit(spark, sf)
    return rounded(E.additive_predict(t, f).select("row_key", "pred"))


@query("e8_fit_predict_score", "E8", WITH_META + FIT + f""", p as (select meta.*, coalesce(my, mu) + coalesce(g, 0) + coalesce(e, 0) as pred from meta left join yr using (year) left join g using (hybrid) left join e using (env), mu),
m as (select env, count(*) as n, regr_sxx(pred, yield_mg) as saa, regr_syy(pred, yield_mg) as spp, regr_sxy(pred, yield_mg) as sap from p where year = 2000 group by env)
select count(*) as n_envs, {q6('avg(greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp)))))')} as macro_pcc from m where n >= 2 and saa > 1e-8 and spp > 1e-8""")
def _(spark, sf):
    """The whole loop: fit on the training years, predict the next one, score it."""
    t, f = fit(spark, sf)
    scored = E.additive_predict(t.filter("year = 2000"), f).withColumn("actual", F.col("yield_mg"))
    return rounded(M.macro_env_pcc(scored))
