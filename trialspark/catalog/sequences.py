"""Ordered-scan and pick queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark.catalog import query
from trialspark.catalog.common import WITH_PRED, pred, q6, r6, rounded
from trialspark.catalog.metrics import SAFE_R, moments_sql
from trialspark.catalog.sources import metric_log
from trialspark.operators import metrics as M
from trialspark.operators import ordering as O
from trialspark.operators import sequences as W

PATIENCE = 5

# the fold, one recursion step per epoch
TRACE = """with recursive lg as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as pos,
 {pcc} as pcc, -value as loss, event_id % 97 as tm from events),
r as (
 select run, 0::bigint as pos, null::double as bp, null::double as bl, false as imp from (select distinct run from lg)
 union all
 select r.run, lg.pos, case when {imp} then coalesce(lg.pcc, r.bp) else r.bp end, case when {imp} then lg.loss else r.bl end, {imp}
 from r join lg on lg.run = r.run and lg.pos = r.pos + 1),
mk as (select run, pos from r where imp or pos = 0), nx as (select run, pos, lead(pos) over (partition by run order by pos) as nxt from mk),
sz as (select run, count(*) as n_epochs from lg group by run),
st as (select run, min(pos + {p} + 1) as stop_pos from nx join sz using (run) where (nxt is null or nxt > pos + {p} + 1) and pos + {p} + 1 <= n_epochs group by run),
kp as (select r.run, r.pos from r left join st using (run) where imp and (stop_pos is null or r.pos <= stop_pos))
"""
IMP = """(case when lg.pcc is not null then coalesce(lg.pcc > r.bp + 1e-8::double or (abs(lg.pcc - r.bp) <= 1e-8::double and lg.loss < r.bl), true)
 else r.bp is null and lg.loss < coalesce(r.bl, 'inf'::double) end)"""


def trace_sql(pcc: str, scale: bool = False) -> str:
    head = TRACE.format(pcc=pcc, imp=IMP, p=PATIENCE)
    extra = ", arg_min(kp.pos, (lg.tm, kp.pos)) as best_scale_epoch" if scale else ""
    return head + f"""select sz.run, max(kp.pos) as best_epoch, arg_max(lg.pcc, kp.pos) as best_pcc, arg_max(lg.loss, kp.pos) as best_loss, count(kp.pos) as n_improved, max(stop_pos) as stop_epoch, max(n_epochs) as n_epochs{extra}
from sz left join kp using (run) left join lg on lg.run = kp.run and lg.pos = kp.pos left join st on st.run = sz.run group by sz.run"""


@query("w2_early_stop_trace", "W2", trace_sql("value/1000"))
def _(spark, sf):
    return W.early_stop_trace(metric_log(spark, sf), PATIENCE)


@query("w2_early_stop_ties", "W2", trace_sql("case when event_type <> 'error' then round(value/1000, 2) end"))
def _(spark, sf):
    """Coarse correlations tie often and some epochs are undefined."""
    log = metric_log(spark, sf)
    pcc = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round("val_pcc", 2))
    return W.early_stop_trace(log.withColumn("val_pcc", pcc), PATIENCE)


@query("w3_best_scale_epoch", "W3", f"select run, best_scale_epoch from ({trace_sql('value/1000', True)})")
def _(spark, sf):
    log = metric_log(spark, sf).withColumn("total_env_mse", F.col("event_id") % 97)
    return W.best_scale_epoch(log, PATIENCE)


def location_runs(spark, sf):
    """One run per location with several scores."""
    df = pred(spark, sf)
    aggs = []
    for name, model, year in (("cv_val_pcc", "m_b", 2000), ("test_pcc", "m_b", 2001), ("lygo_pcc", "m_d", 2000), ("leo_pcc", "m_c", 1999)):
        a = F.when(F.col("year") == year, F.col("actual"))
        aggs.append(F.try_divide(F.regr_sxy(model, a), F.sqrt(F.regr_sxx(model, a)) * F.sqrt(F.regr_syy(model, a))).alias(name))
    return df.groupBy(F.col("location").alias("run_id")).agg(*aggs)


def _loc_r(model: str, year: int) -> str:
    a = f"case when year = {year} then actual end"
    return f"regr_sxy({model}, {a})/nullif(sqrt(regr_sxx({model}, {a}))*sqrt(regr_syy({model}, {a})), 0)"


SQL_RUNS = WITH_PRED.rstrip() + f""", runs as (select location as run_id, {_loc_r('m_b', 2000)} as cv_val_pcc, {_loc_r('m_b', 2001)} as test_pcc, {_loc_r('m_d', 2000)} as lygo_pcc, {_loc_r('m_c', 1999)} as leo_pcc from pred group by location)
"""


@query("w4_rank_concordance", "W4", SQL_RUNS + f""", rk as (select run_id as tag, cv_val_pcc, test_pcc, row_number() over (order by cv_val_pcc desc, run_id) - 1 as cv_rank, row_number() over (order by test_pcc desc, run_id) - 1 as test_rank, count(*) over () as n from runs where cv_val_pcc is not null and test_pcc is not null)
select tag, {q6('cv_val_pcc')} as cv_val_pcc, {q6('test_pcc')} as test_pcc, cv_rank, test_rank, case when cv_rank = 0 then test_rank <= 1 end as cv_best_in_top2, case when cv_rank = n - 1 then test_rank >= n - 2 end as cv_worst_in_bottom2 from rk""")
def _(spark, sf):
    return rounded(W.rank_concordance(location_runs(spark, sf).withColumnRenamed("run_id", "tag")))


@query("l3_ordered_report", "L3", WITH_PRED + f""", m as ({moments_sql('m_b')}), r as (select env, {SAFE_R} as pcc from m)
select env, {q6('pcc')} as pcc, row_number() over (order by pcc desc, env) as place from r where pcc is not null""")
def _(spark, sf):
    report = M.env_pcc_report(pred(spark, sf), pred="m_b")
    return rounded(O.positions(report.drop("n"), [], [F.desc("pcc"), F.col("env")], "place"))


def fold_records(spark, sf):
    """One record per validation year with the macro PCC and MSE of the second model."""
    df = pred(spark, sf)
    m = M.pcc_from_moments(M.env_moments(df, ["year", "env"], "actual", "m_b"))
    y = F.col("year")
    per = m.groupBy("year").agg(F.avg("r").alias("best_val_env_avg_pearson"), (F.sum("sse") / F.sum("n")).alias("best_val_loss"), F.count(F.lit(1)).cast("int").alias("best_epoch"))
    ckpt = F.when(y == 1998, F.lit("")).otherwise(F.concat(F.lit("ckpt_"), (y % 4).cast("string")))
    return per.select((y - 1995).alias("fold_idx"), (y - 1).alias("train_year_max"), y.alias("val_year"), "best_epoch", "best_val_loss", "best_val_env_avg_pearson", ckpt.alias("best_checkpoint"))


SQL_FOLDS = WITH_PRED.rstrip() + """, fm as (select year, env, count(*) as n, regr_sxx(m_b, actual) as saa, regr_syy(m_b, actual) as spp, regr_sxy(m_b, actual) as sap, sum(power(actual-m_b,2)) as sse from pred group by year, env),
folds as (select year - 1995 as fold_idx, year - 1 as train_year_max, year as val_year, count(*)::int as best_epoch, sum(sse)/sum(n) as best_val_loss,
 avg(case when n >= 2 and saa > 1e-8 and spp > 1e-8 then greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp)))) end) as best_val_env_avg_pearson,
 case when year = 1998 then '' else concat('ckpt_', year % 4) end as best_checkpoint from fm group by year)
"""


@query("l4_best_and_latest_fold", "L4", SQL_FOLDS + f"""select * from (select 'best' as pick, fold_idx, val_year, {q6('best_val_env_avg_pearson')} as pcc, best_checkpoint from folds order by best_val_env_avg_pearson desc, best_val_loss, fold_idx limit 1)
union all select * from (select 'latest', fold_idx, val_year, {q6('best_val_env_avg_pearson')}, best_checkpoint from folds order by val_year desc limit 1)""")
def _(spark, sf):
    folds = fold_records(spark, sf)
    cols = ["fold_idx", "val_year", r6("best_val_env_avg_pearson").alias("pcc"), "best_checkpoint"]
    a = W.best_fold(folds).select(F.lit("best").alias("pick"), *cols)
    return a.unionByName(W.latest_fold(folds).select(F.lit("latest").alias("pick"), *cols))
