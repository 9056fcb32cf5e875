"""Metric queries (M0–M25, F1) over the four model columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.catalog import query
from trialspark.catalog.common import WITH_PRED, pred, q6, r6, rounded, train_test
from trialspark.operators import effects as E
from trialspark.operators import metrics as M
from trialspark.operators import ranking as R


def moments_sql(p: str = "m_a", group: str = "env", src: str = "pred") -> str:
    return f"""select {group}, count(*) as n, avg(actual) as ma, avg({p}) as mp,
      regr_sxx({p}, actual) as saa, regr_syy({p}, actual) as spp, regr_sxy({p}, actual) as sap,
      sum(power(actual-{p},2)) as sse,
      min(actual) as lo_a, max(actual) as hi_a, arg_min(actual, row_key) as v0_a,
      min({p}) as lo_p, max({p}) as hi_p, arg_min({p}, row_key) as v0_p
      from {src} group by {group}"""


FLAT_A = "greatest(hi_a-v0_a, v0_a-lo_a) <= 1e-8::double + 1e-5::double*abs(v0_a)"
FLAT_P = "greatest(hi_p-v0_p, v0_p-lo_p) <= 1e-8::double + 1e-5::double*abs(v0_p)"
SAFE_R = f"case when n >= 2 and not ({FLAT_A}) and not ({FLAT_P}) then sap/(sqrt(saa)*sqrt(spp)) end"
SLOPE = f"case when n >= 2 and not ({FLAT_A}) then sap/saa end"
CLAMP_R = "greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp))))"
OK_R = "n >= 2 and saa > 1e-8 and spp > 1e-8"


@query("f1_finite_pairs", "F1", WITH_PRED + f"""select env, count(*) as n, {q6('sum(ratio)', 3)} as sum_ratio
from (select env, m_a / (case when l_discount = 0 then null else l_discount end) as ratio from pred) where ratio is not null group by env""")
def _(spark, sf):
    df = pred(spark, sf).withColumn("ratio", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("m_a") / F.when(F.col("l_discount") != 0, F.col("l_discount"))))
    kept = M.finite_pairs(df, "actual", "ratio")
    return rounded(kept.groupBy("env").agg(F.count(F.lit(1)).alias("n"), F.sum("ratio").alias("sum_ratio")), 3)


@query("m0_env_moments", "M0", WITH_PRED + f""", m as ({moments_sql()})
select env, n, {q6('ma')} as mean_a, {q6('mp')} as mean_p, {q6('saa', 4)} as saa, {q6('spp', 4)} as spp, {q6('sap', 4)} as sap from m""")
def _(spark, sf):
    m = M.env_moments(pred(spark, sf), "env", "actual", "m_a")
    d = {"saa": 4, "spp": 4, "sap": 4}
    return m.select("env", "n", *[r6(c, d.get(c, 6)).alias(c) for c in ("mean_a", "mean_p", "saa", "spp", "sap")])


@query("m1_safe_pcc", "M1", WITH_PRED + f", m as ({moments_sql('m_b')}) select env, n, {q6(SAFE_R)} as pcc from m")
def _(spark, sf):
    return rounded(M.safe_pcc(pred(spark, sf), "env", "actual", "m_b"))


@query("m2_macro_env_pcc", "M2", WITH_PRED + f""", m as ({moments_sql()})
select count(*) as n_envs, {q6(f'avg({CLAMP_R})')} as macro_pcc from m where {OK_R}""")
def _(spark, sf):
    return rounded(M.macro_env_pcc(pred(spark, sf), pred="m_a"))


BATCH_R = """case when n >= 4 and saa/n > 1e-8 and spp/n > 1e-8 then
 greatest(-1.0::double, least(1.0::double, (sap/n)/(sqrt(saa/n)*sqrt(spp/n)+1e-8::double))) end"""


@query("m3_envpcc_loss", "M3", WITH_PRED + f""", m as ({moments_sql('m_b')})
select count({BATCH_R}) as n_envs, {q6(f'1 - avg({BATCH_R})')} as loss from m""")
def _(spark, sf):
    return rounded(M.envpcc_loss(pred(spark, sf), pred="m_b"))


@query("m3_envpcc_loss_fallback", "M3", WITH_PRED + f"""
select 0 as n_envs, {q6('1 - regr_sxy(m_b, actual)/(sqrt(regr_sxx(m_b, actual))*sqrt(regr_syy(m_b, actual)))')} as loss from pred""")
def _(spark, sf):
    """One row per group, so no group qualifies and the loss of all rows together is used."""
    return rounded(M.envpcc_loss(pred(spark, sf), group="row_key", pred="m_b").withColumn("n_envs", F.col("n_envs").cast("int")))


@query("m4_weighted_env_pcc", "M4", WITH_PRED + f""", m as ({moments_sql('m_b')})
select cast(sum(n) as bigint) as n_rows, {q6(f'sum({CLAMP_R}*n)/sum(n)')} as weighted_pcc from m where {OK_R}""")
def _(spark, sf):
    return rounded(M.weighted_env_pcc(pred(spark, sf), pred="m_b"))


@query("m5_global_pcc", "M5", WITH_PRED + f"""select count(*) as n,
{q6('regr_sxy(m_d, actual)/(sqrt(regr_sxx(m_d, actual))*sqrt(regr_syy(m_d, actual)))')} as pcc,
{q6('1-regr_sxy(m_d, actual)/(sqrt(regr_sxx(m_d, actual))*sqrt(regr_syy(m_d, actual)))')} as loss from pred""")
def _(spark, sf):
    return rounded(M.global_pcc(pred(spark, sf), pred="m_d"))


@query("m6_mse", "M6", WITH_PRED + f"select count(*) as n, {q6('avg(power(actual-m_a,2))')} as mse from pred")
def _(spark, sf):
    return rounded(M.mse(pred(spark, sf), pred="m_a"))


@query("m7_macro_env_mse", "M7", WITH_PRED + f""", m as ({moments_sql('m_c')})
select 'n1' as rule, count(*) as n_envs, {q6('avg(sse/n)')} as env_mse from m
union all select 'n2', count(*), {q6('avg(sse/n)')} from m where n >= 2
union all select 'n500_fallback', count(case when n >= 1000000000 then 1 end), {q6('sum(sse)/sum(n)')} from m""")
def _(spark, sf):
    df = pred(spark, sf)
    rules = [("n1", 1, False), ("n2", 2, False), ("n500_fallback", 10**9, True)]
    moments = M.env_moments(df, "env", "actual", "m_c")
    out = None
    for name, n, fb in rules:
        one = M._macro_env_mse(moments, n, fb).select(F.lit(name).alias("rule"), "n_envs", "env_mse")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


CCC = """case when n >= 2 and saa/n > 1e-8 and spp/n > 1e-8 then greatest(-1.0::double, least(1.0::double,
 2*sap/n/(saa/n + spp/n + power(mp-ma,2) + 1e-8::double))) end"""


@query("m8_envccc_loss", "M8", WITH_PRED + f", m as ({moments_sql('m_b')}) select count({CCC}) as n_envs, {q6(f'1-avg({CCC})')} as loss from m")
def _(spark, sf):
    return rounded(M.envccc_loss(pred(spark, sf), pred="m_b"))


@query("m9_scale_fit", "M9", WITH_PRED + f""", m as ({moments_sql('m_b')})
select env, n, {q6(SLOPE)} as slope, {q6(f'mp - ({SLOPE})*ma')} as intercept from m""")
def _(spark, sf):
    return rounded(M.scale_fit(pred(spark, sf), "env", pred="m_b"))


def board_sql(group: str, src: str = "pred") -> str:
    """Scoreboard columns per group for ``pred`` and ``rank_pred``."""
    return f"""select a.{group}, a.n, {q6(SAFE_R.replace('n >=', 'a.n >='))} as pcc, b.rank_pcc,
      {q6(SLOPE)} as slope, {q6(f'mp - ({SLOPE})*ma')} as intercept, b.rank_slope, b.rank_intercept, {q6('sse/a.n')} as mse
      from ({moments_sql('pred', group, src)}) a
      join (select {group} as g2, {q6(SAFE_R)} as rank_pcc, {q6(SLOPE)} as rank_slope, {q6(f'mp - ({SLOPE})*ma')} as rank_intercept
            from ({moments_sql('rank_pred', group, src)})) b on a.{group} is not distinct from b.g2"""


@query("m10_split_metrics", "M10", WITH_PRED + board_sql("location"))
def _(spark, sf):
    return rounded(M.split_metrics(pred(spark, sf), "location"))


@query("m11_novelty_metrics", "M11", WITH_PRED + f""", te as (select p.*, hybrid not in (select hybrid from meta where year < 2001) as novel_hybrid
from pred p where year = 2001) {board_sql('novel_hybrid', 'te')}""")
def _(spark, sf):
    train, test = train_test(pred(spark, sf))
    return rounded(M.novelty_metrics(test, train))


@query("m12_tester_metrics", "M12", WITH_PRED + f", t as (select *, coalesce(nullif(trim(parent2), ''), 'UNK') as tester from pred) {board_sql('tester', 't')}")
def _(spark, sf):
    return rounded(M.tester_metrics(pred(spark, sf)))


@query("m13_env_pcc_report", "M13", WITH_PRED + f", m as ({moments_sql()}) select env, n, {q6(SAFE_R)} as pcc from m where ({SAFE_R}) is not null")
def _(spark, sf):
    return rounded(M.env_pcc_report(pred(spark, sf), pred="m_a"))


@query("m14_run_metrics", "M14", WITH_PRED + f""", e as ({moments_sql('pred')}), g as ({moments_sql('pred', '1::int', 'pred').replace('select 1::int, ', 'select ').replace('group by 1::int', '')}),
 gr as ({moments_sql('rank_pred', '1::int', 'pred').replace('select 1::int, ', 'select ').replace('group by 1::int', '')}),
 er as (select avg({CLAMP_R}) as env_pcc, sum({CLAMP_R}*n)/sum(n) as env_pcc_weighted from e where {OK_R}),
 em as (select avg(sse/n) as env_mse from e),
 rl as (select {SLOPE} as rank_slope, mp - ({SLOPE})*ma as rank_intercept from gr)
select n, {q6(SAFE_R)} as global_pcc, {q6('sse/n')} as global_mse, {q6(SLOPE)} as slope, {q6(f'mp-({SLOPE})*ma')} as intercept,
 {q6('rank_slope')} as rank_slope, {q6('rank_intercept')} as rank_intercept, {q6('env_pcc')} as env_pcc, {q6('env_mse')} as env_mse,
 {q6('env_pcc_weighted')} as env_pcc_weighted from g, er, em, rl""")
def _(spark, sf):
    return rounded(M.run_metrics(pred(spark, sf)))


@query("m15_env_level_pcc", "M15", WITH_PRED + f""", m as (select env, avg(m_c) as p, avg(actual) as t from pred group by env)
select count(*) as n_envs, {q6('regr_sxy(p,t)/(sqrt(regr_sxx(p,t))*sqrt(regr_syy(p,t)))')} as env_level_pcc from m""")
def _(spark, sf):
    return rounded(M.env_level_pcc(pred(spark, sf), "actual", "m_c"))


@query("m16_masked_mse", "M16", WITH_PRED + f""", k as (select * from pred where hybrid in (select hybrid from meta where year < 2000)),
 e as (select env, count(*) as n, avg(power(actual-m_a,2)) as v from k group by env)
select (select count(*) from k) as n, {q6('(select avg(power(actual-m_a,2)) from k)')} as mse, (select count(*) from e where n >= 2) as n_envs, {q6('(select avg(v) from e where n >= 2)')} as env_mse""")
def _(spark, sf):
    df = pred(spark, sf)
    flagged = M.novelty_flag(df, df.filter("year < 2000")).withColumn("known", ~F.col("novel_hybrid"))
    a = M.masked_mse(flagged, "known", "mse", pred="m_a").withColumn("one", F.lit(1))
    b = M.masked_mse(flagged, "known", "envmse", pred="m_a").withColumn("one", F.lit(1))
    return rounded(a.join(b, "one").drop("one"))


@query("m17_selection_metric", "M17", WITH_PRED + f""", m as (select location, avg(power(actual-m_b,2)) as mse,
 regr_sxy(m_b,actual)/(sqrt(regr_sxx(m_b,actual))*sqrt(regr_syy(m_b,actual))) as pcc from pred group by location)
select location, {q6('mse - 5*coalesce(pcc,0)')} as score, false as higher_is_better from m
union all select location, {q6('pcc')}, true from m""")
def _(spark, sf):
    board = M.split_metrics(pred(spark, sf), "location", pred="m_b").select("location", "mse", "pcc")
    both = M.selection_metric(board, "mse_corr").unionByName(M.selection_metric(board, "pcc"))
    return rounded(both.select("location", "score", "higher_is_better"))


RANKED = """, rk as (select *, rank() over (partition by env order by actual) + (count(*) over (partition by env, actual) - 1)/2.0::double as ra,
 rank() over (partition by env order by {p}) + (count(*) over (partition by env, {p}) - 1)/2.0::double as rp from pred)"""


@query("m18_env_spearman", "M18", WITH_PRED + RANKED.format(p="m_b") + f"""select env, count(*) as n,
{q6('1 - 6*sum(power(ra-rp,2))/(count(*)::double*(count(*)::double*count(*)::double-1))')} as spearman from rk group by env""")
def _(spark, sf):
    return rounded(R.env_spearman(pred(spark, sf), "env", pred="m_b"))


@query("m19_spearman", "M19", WITH_PRED + f""", rk as (select rank() over (order by actual) + (count(*) over (partition by actual) - 1)/2.0::double as ra,
 rank() over (order by m_d) + (count(*) over (partition by m_d) - 1)/2.0::double as rp from pred)
select count(*) as n, {q6('regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra)))')} as spearman,
{q6('1-regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra)))')} as loss from rk""")
def _(spark, sf):
    return rounded(R.spearman(pred(spark, sf), pred="m_d"))


@query("m20_ktau", "M20", WITH_PRED + f""", o as (select env, actual, row_number() over (partition by env order by m_b, row_key) as pos from pred),
 c as (select a.env, count(case when b.actual > a.actual then 1 end) as c, count(case when b.actual < a.actual then 1 end) as d
 from o a join o b on a.env = b.env and a.pos < b.pos group by a.env), z as (select env, count(*) as n from o group by env)
select env, n, c as concordant, d as discordant, {q6('(c-d)::double/(c+d)')} as tau, {q6('1-(c-d)::double/(c+d)')} as loss from c join z using (env)""")
def _(spark, sf):
    return rounded(R.ktau(pred(spark, sf), "env", pred="m_b"))


@query("m21_rank_hinge", "M21", WITH_PRED + f""", k as (select env, actual, m_b as p from pred where env in (select env from pred group by env having count(*) >= 3))
select count(*) as n_pairs, {q6('avg(greatest(0.0::double, 0.5::double - (i.p - j.p)))')} as hinge
from k i join k j on i.env = j.env and j.actual < i.actual - 0.2::double""")
def _(spark, sf):
    return rounded(R.rank_hinge(pred(spark, sf), pred="m_b"))


@query("m22_rank_consistency", "M22", WITH_PRED + f""", o as (select hybrid, row_number() over (partition by hybrid order by m_b, row_key) as rp,
 row_number() over (partition by hybrid order by actual, row_key) as ra from pred),
 h as (select hybrid, 1 - regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra))) as l from o group by hybrid having count(*) >= 2)
select count(*) as n_hybrids, {q6('coalesce(avg(l),0)')} as loss from h""")
def _(spark, sf):
    return rounded(R.rank_consistency(pred(spark, sf), pred="m_b"))


@query("m23_huber", "M23", WITH_PRED + f"""select count(*) as n, {q6('avg(case when abs(m_b-actual) < 1 then 0.5::double*power(m_b-actual,2) else abs(m_b-actual)-0.5::double end)')} as huber from pred""")
def _(spark, sf):
    return rounded(M.huber(pred(spark, sf), pred="m_b"))


@query("m24_composite_score", "M24", WITH_PRED + f""", m as ({moments_sql('m_b')}),
 t as (select 'mse' as term, 1.0::double as weight, avg(power(actual-m_b,2)) as value from pred
 union all select 'envpcc', 0.5::double, (select 1 - avg({BATCH_R}) from m)
 union all select 'envccc', 2.0::double, (select 1 - avg({CCC}) from m)
 union all select 'envmse', 0.25::double, (select avg(sse/n) from m where n >= 2)
 union all select 'pcc', 1.5::double, 1 - regr_sxy(m_b, actual)/(sqrt(regr_sxx(m_b, actual))*sqrt(regr_syy(m_b, actual))) from pred)
select term, {q6('weight')} as weight, {q6('value')} as value, {q6('weight*value')} as weighted from t
union all select 'total', {q6('sum(weight)')}, {q6('sum(value)')}, {q6('sum(weight*value)')} from t""")
def _(spark, sf):
    return rounded(M.composite_score(pred(spark, sf), "mse+envpcc+envccc+envmse+pcc", "1,0.5,2,0.25,1.5", pred="m_b"))


@query("m24_composite_rank_terms", "M24", WITH_PRED + RANKED.format(p="m_b") + f""",
 es as (select 1 - 6*sum(power(ra-rp,2))/(count(*)::double*(count(*)::double*count(*)::double-1)) as s from rk group by env),
 k as (select env, actual, m_b as p from pred where env in (select env from pred group by env having count(*) >= 3)),
 t as (select 'envspearman' as term, 1.0::double as weight, (select 1 - avg(s) from es) as value
 union all select 'triplet', 2.0::double, (select avg(greatest(0.0::double, 0.5::double - (i.p - j.p))) from k i join k j on i.env = j.env and j.actual < i.actual - 0.2::double))
select term, {q6('weight')} as weight, {q6('value')} as value, {q6('weight*value')} as weighted from t
union all select 'total', {q6('sum(weight)')}, {q6('sum(value)')}, {q6('sum(weight*value)')} from t""")
def _(spark, sf):
    return rounded(M.composite_score(pred(spark, sf), "envspearman+triplet", "1,2", pred="m_b"))


GAPS = """, g as (select * replace (case when site = 4 then null else env end as env, case when l_quantity = 11 then null else actual end as actual) from pred)"""


def gaps(spark, sf):
    """Predictions with a NULL environment and NULL actual values."""
    null = F.lit(None)
    return pred(spark, sf).withColumns(
        {"env": F.when(F.col("site") == 4, null).otherwise(F.col("env")), "actual": F.when(F.col("l_quantity") == 11, null).otherwise(F.col("actual"))}
    )


@query("m18_env_spearman_gaps", "M18", WITH_PRED + GAPS + f""", rk as (select *, rank() over (partition by env order by actual nulls first) + (count(*) over (partition by env, actual) - 1)/2.0::double as ra,
 rank() over (partition by env order by m_b) + (count(*) over (partition by env, m_b) - 1)/2.0::double as rp from g)
select env, count(*) as n, {q6('1 - 6*sum(power(ra-rp,2))/(count(*)::double*(count(*)::double*count(*)::double-1))')} as spearman from rk group by env""")
def _(spark, sf):
    return rounded(R.env_spearman(gaps(spark, sf), "env", pred="m_b"))


@query("m19_spearman_gaps", "M19", WITH_PRED + GAPS + f""", rk as (select rank() over (order by actual nulls first) + (count(*) over (partition by actual) - 1)/2.0::double as ra,
 rank() over (order by m_d) + (count(*) over (partition by m_d) - 1)/2.0::double as rp from g)
select count(*) as n, {q6('regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra)))')} as spearman,
{q6('1-regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra)))')} as loss from rk""")
def _(spark, sf):
    return rounded(R.spearman(gaps(spark, sf), pred="m_d"))


@query("m20_ktau_gaps", "M20", WITH_PRED + GAPS + f""", o as (select coalesce(env, '?') as e, dense_rank() over (partition by env order by actual nulls first) as v, row_number() over (partition by env order by m_b, row_key) as pos from g),
 c as (select a.e, count(case when b.v > a.v then 1 end) as c, count(case when b.v < a.v then 1 end) as d from o a join o b on a.e = b.e and a.pos < b.pos group by a.e),
 z as (select e, count(*) as n from o group by e)
select nullif(e, '?') as env, n, c as concordant, d as discordant, {q6('(c-d)::double/(c+d)')} as tau, {q6('1-(c-d)::double/(c+d)')} as loss from c join z using (e)""")
def _(spark, sf):
    return rounded(R.ktau(gaps(spark, sf), "env", pred="m_b"))


@query("m21_rank_hinge_gaps", "M21", WITH_PRED + GAPS + f""", n as (select coalesce(env, '?') as e, actual, m_b as p from g), k as (select * from n where e in (select e from n group by e having count(*) >= 3))
select count(*) as n_pairs, {q6('avg(greatest(0.0::double, 0.5::double - (i.p - j.p)))')} as hinge
from k i join k j on i.e = j.e and (j.actual < i.actual - 0.2::double or (j.actual is null and i.actual is not null))""")
def _(spark, sf):
    return rounded(R.rank_hinge(gaps(spark, sf), pred="m_b"))


@query("m24_composite_spearman", "M24", WITH_PRED + f""", rk as (select rank() over (order by actual) + (count(*) over (partition by actual) - 1)/2.0::double as ra,
 rank() over (order by m_b) + (count(*) over (partition by m_b) - 1)/2.0::double as rp from pred),
 t as (select 'spearman' as term, 2.0::double as weight, (select 1-regr_sxy(rp,ra)/(sqrt(regr_sxx(rp,ra))*sqrt(regr_syy(rp,ra))) from rk) as value union all select 'mse', 1.0::double, (select avg(power(actual-m_b,2)) from pred))
select term, {q6('weight')} as weight, {q6('value')} as value, {q6('weight*value')} as weighted from t
union all select 'total', {q6('sum(weight)')}, {q6('sum(value)')}, {q6('sum(weight*value)')} from t""")
def _(spark, sf):
    return rounded(M.composite_score(pred(spark, sf), "spearman+mse", "2,1", pred="m_b"))


@query("m25_residual_part_metrics", "M25", WITH_PRED + f""", e as (select env, avg(actual) as ym, avg(m_a) as pm from pred group by env)
select {q6('avg(power(actual-m_a,2))')} as mse_total, {q6('avg(power(ym-pm,2))')} as mse_env_mean, {q6('avg(power((actual-ym)-(m_a-pm),2))')} as mse_residual
from pred join e using (env)""")
def _(spark, sf):
    df = E.env_residuals(E.env_residuals(pred(spark, sf), "actual", mean="ymean", resid="resid"), "m_a", mean="ymean_pred", resid="resid_pred")
    return rounded(M.residual_part_metrics(df, {"total": ("actual", "m_a"), "env_mean": ("ymean", "ymean_pred"), "residual": ("resid", "resid_pred")}))
