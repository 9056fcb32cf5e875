"""Feature fitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_MARKERS, WITH_META, WITH_TT, q6, r6, rounded, train_test
from trialspark.operators import effects as E
from trialspark.operators import features as T

NUM = ["l_quantity", "l_discount", "l_tax"]


def covariates(spark, sf):
    """One row per environment with numeric features and two categoricals, one of them with gaps."""
    t = FX.trials(spark, sf)
    num = t.groupBy("env").agg(
        F.avg("l_quantity").alias("q_mean"), F.avg("l_discount").alias("d_mean"), F.avg("l_tax").alias("t_mean"),
        F.stddev_pop("l_quantity").alias("q_std"), F.min("l_quantity").alias("q_min"), F.max("l_quantity").alias("q_max"),
    )
    for src, name in (("c_mktsegment", "segment"), ("o_orderpriority", "priority")):
        n = t.groupBy("env", src).agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("env").agg(F.min_by(src, F.struct(-F.col("n"), F.col(src))).alias(name))
        num = num.join(top, "env")
    blank = F.when(F.col("env").endswith("_1995"), F.lit("")).when(F.col("env").endswith("_1996"), F.lit("nan")).otherwise(F.col("segment"))
    return num.withColumn("segment", blank)


SQL_COV = WITH_META.rstrip() + """, num as (select env, avg(l_quantity) as q_mean, avg(l_discount) as d_mean, avg(l_tax) as t_mean, stddev_pop(l_quantity) as q_std,
 min(l_quantity) as q_min, max(l_quantity) as q_max from trials group by env),
s1 as (select env, c_mktsegment as v, row_number() over (partition by env order by count(*) desc, c_mktsegment) as k from trials group by env, c_mktsegment),
s2 as (select env, o_orderpriority as v, row_number() over (partition by env order by count(*) desc, o_orderpriority) as k from trials group by env, o_orderpriority),
cov as (select num.*, case when env like '%_1995' then 'UNK' when env like '%_1996' then 'UNK' else s1.v end as segment, s2.v as priority
 from num join s1 using (env) join s2 using (env) where s1.k = 1 and s2.k = 1)
"""
COV_NUM = ["q_mean", "d_mean", "t_mean", "q_std", "q_min", "q_max"]


@query("t1_preprocess_env", "T1", SQL_COV + f"select 'drop' as mode, count(*) as n, 7 as n_columns from cov union all select 'onehot', count(*), 7 + count(distinct segment) + count(distinct priority) from cov")
def _(spark, sf):
    c = covariates(spark, sf)
    out = None
    for mode in ("drop", "onehot"):
        d = T.preprocess_env(c, mode, ["segment", "priority"])
        one = d.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.lit(len(d.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("t2_onehot_vocab", "T2", SQL_COV + """select 'segment' as "column", segment as value from cov group by 2 union all select 'priority', priority from cov group by 2""")
def _(spark, sf):
    return T.fit_onehot(covariates(spark, sf), ["segment", "priority"])


@query("t2_onehot_apply", "T2", SQL_COV + """, l as (select env, 'segment=' || segment as feature from cov union all select env, 'priority=' || priority from cov)
select feature, count(*)::double as total, min(env) as first_env from l group by feature""")
def _(spark, sf):
    c = covariates(spark, sf)
    d = T.apply_onehot(c, T.fit_onehot(c, ["segment", "priority"]), ["segment", "priority"])
    hot = [n for n in d.columns if "=" in n]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("v")) for n in hot]))
    long = d.select("env", pairs.alias("p")).select("env", "p.feature", "p.v")
    return long.groupBy("feature").agg(F.sum("v").alias("total"), F.min(F.when(F.col("v") == 1, F.col("env"))).alias("first_env"))


@query("t2_onehot_ids", "T2", SQL_COV + """, l as (select env, 'segment' as c, segment as v from cov union all select env, 'priority', priority from cov),
v as (select c, v, row_number() over (order by c, v) - 1 as id from (select distinct c, v from l where env not like '%_2001'))
select env, coalesce(string_agg(id::varchar, ',' order by id), '') as ids from l left join v using (c, v) group by env""")
def _(spark, sf):
    """Sparse one-hot ids: the vocabulary is joined and never collected."""
    c = covariates(spark, sf)
    vocab = T.fit_onehot(c.filter(~F.col("env").endswith("_2001")), ["segment", "priority"])
    return T.onehot_ids(c, vocab, ["segment", "priority"]).select("env", F.array_join("onehot", ",").alias("ids"))


@query("t3_align_schema", "T3", SQL_COV + f"""select env, {q6('q_mean')} as q_mean, 0.0::double as "priority=9-NEVER", case when segment = 'BUILDING' then 1.0::double else 0.0::double end as "segment=BUILDING", {q6('q_std')} as q_std from cov where env like '%_2001'""")
def _(spark, sf):
    c = covariates(spark, sf)
    val = c.filter(F.col("env").endswith("_2001"))
    hot = T.apply_onehot(val, T.fit_onehot(c, ["segment", "priority"]), ["segment", "priority"])
    aligned = T.align_schema(hot, ["q_mean", "priority=9-NEVER", "segment=BUILDING", "q_std"], ["env"])
    return aligned.withColumns({"q_mean": r6("q_mean"), "q_std": r6("q_std")})


SQL_SCALER = SQL_COV.rstrip() + ", trn as (select * from cov where env not like '%_2001'), f as (" + " union all ".join(
    f"select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std from trn" for c in COV_NUM) + ")\n"


@query("t4_fit_scaler", "T4", SQL_SCALER + f"select feature, {q6('mean')} as mean, {q6('std')} as std, {q6('case when std = 0 then 1 else std end')} as scale from f")
def _(spark, sf):
    return rounded(T.fit_scaler(covariates(spark, sf).filter(~F.col("env").endswith("_2001")), COV_NUM))


@query("t4_apply_scaler", "T4", SQL_SCALER + "select env, " + ", ".join(
    f"""{q6(f"({c} - (select mean from f where feature = '{c}'))/(select case when std = 0 then 1 else std end from f where feature = '{c}')")} as {c}""" for c in COV_NUM) + " from cov")
def _(spark, sf):
    c = covariates(spark, sf).select("env", *COV_NUM)
    return rounded(T.apply_scaler(c, T.fit_scaler(c.filter(~F.col("env").endswith("_2001")), COV_NUM), COV_NUM))


SQL_LONG = ", l as (select vec_id, unnest(markers) as x, unnest(range(len(markers))) as marker from markers)"
SQL_STATS = SQL_LONG + """, st as (select marker, greatest(0.0::double, least(1.0::double, avg(x))) as p from l where vec_id % 5 <> 0 group by marker),
 s2 as (select marker, p, case when sqrt(2*p*(1-p)) > 1e-8 then sqrt(2*p*(1-p)) else 1.0::double end as scale, sqrt(2*p*(1-p)) > 1e-8 as valid from st)"""


@query("t5_marker_stats", "T5", WITH_MARKERS + SQL_STATS + f" select cast(marker as integer) as marker, {q6('p')} as p, {q6('scale')} as scale, valid from s2")
def _(spark, sf):
    return rounded(T.fit_marker_stats(FX.markers(spark, sf).filter("vec_id % 5 <> 0")))


@query("t5_marker_standardise", "T5", WITH_MARKERS + SQL_STATS + f" select vec_id, cast(marker as integer) as marker, {q6('case when valid then (2*x-2*p)/scale else 0 end')} as z from l join s2 using (marker)")
def _(spark, sf):
    m = FX.markers(spark, sf)
    z = T.apply_marker_stats(m, T.fit_marker_stats(m.filter("vec_id % 5 <> 0")))
    return rounded(z.select("vec_id", F.posexplode("z").alias("marker", "z")))


@query("t6_label_scalers", "T6", WITH_TT + f""", e as (select env, avg(yield_mg) as ym from tr group by env), r as (select yield_mg, ym, yield_mg-ym as rs from tr join e using (env))
select 'total' as label, {q6('avg(yield_mg)')} as mean, {q6('stddev_pop(yield_mg)')} as std from r union all select 'ymean', {q6('avg(ym)')}, {q6('stddev_pop(ym)')} from r
union all select 'resid', {q6('avg(rs)')}, {q6('stddev_pop(rs)')} from r""")
def _(spark, sf):
    tr, _ = train_test(FX.meta_trials(spark, sf))
    return rounded(T.fit_label_scalers(E.env_residuals(tr)))


@query("t7_env_residuals", "T7", WITH_META + f"select row_key, {q6('avg(yield_mg) over (partition by env)')} as ymean, {q6('yield_mg - avg(yield_mg) over (partition by env)')} as resid from trials")
def _(spark, sf):
    return rounded(E.env_residuals(FX.trials(spark, sf)).select("row_key", "ymean", "resid"))


@query("t8_category_codes", "T8", WITH_META + "select hybrid, row_number() over (order by hybrid) - 1 as code from (select distinct hybrid from trials)")
def _(spark, sf):
    return T.category_codes(FX.trials(spark, sf), "hybrid", "code")


SQL_VOCAB = """, x as (select row_key, parent1, case when site = 3 then '' else parent2 end as parent2, year from meta),
v as (select parent, row_number() over (order by parent) as parent_id from (select parent1 as parent from x where year <= 1999 union select parent2 from x where year <= 1999))"""


def _gappy_parents(spark, sf):
    t = FX.meta_trials(spark, sf)
    return t.withColumn("parent2", F.when(F.col("site") == 3, F.lit("")).otherwise(F.col("parent2")))


@query("t9_parent_vocab", "T9", WITH_META + SQL_VOCAB + " select parent, parent_id from v where parent <> ''")
def _(spark, sf):
    return T.fit_parent_vocab(_gappy_parents(spark, sf).filter("year <= 1999"))


@query("t9_parent_ids", "T9", WITH_META + SQL_VOCAB + """, w as (select * from v where parent <> '')
select row_key, coalesce(a.parent_id, 0) as parent1_id, coalesce(b.parent_id, 0) as parent2_id from x left join w a on x.parent1 = a.parent left join w b on x.parent2 = b.parent""")
def _(spark, sf):
    t = _gappy_parents(spark, sf)
    return T.apply_parent_vocab(t, T.fit_parent_vocab(t.filter("year <= 1999"))).select("row_key", "parent1_id", "parent2_id")


@query("t10_allele_freq", "T10", WITH_MARKERS + SQL_LONG + f" select vec_id % 3 as pop, cast(marker as integer) as marker, {q6('avg(x)')} as freq from l group by 1, 2")
def _(spark, sf):
    return rounded(T.allele_freq(FX.markers(spark, sf).withColumn("pop", F.col("vec_id") % 3), ["pop"]))


@query("t11_hybrid_profiles", "T11", WITH_MARKERS + SQL_LONG + f""", h as (select concat('H', vec_id % 150) as hybrid, marker, x from l)
select hybrid, cast(marker as integer) as marker, {q6('avg(x)')} as mean from h group by 1, 2""")
def _(spark, sf):
    m = FX.markers(spark, sf).withColumn("hybrid", F.concat(F.lit("H"), (F.col("vec_id") % 150).cast("string")))
    return rounded(T.hybrid_profiles(m))
