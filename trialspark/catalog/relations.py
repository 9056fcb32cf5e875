"""Filters, projections, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, WITH_PRED, WITH_TT, pred, q6, r6, rounded, train_test
from trialspark.operators import effects as E
from trialspark.operators import pairs as PJ
from trialspark.operators import relations as R
from trialspark.schema import TrialSchema
from trialspark.sources import predictions as SP


@query("f2_filter_years", "F2", WITH_META + "select year, count(*) as n from meta where year between 1997 and 1999 and site <> 3 group by year")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    # the lenient year only knows 20xx, so shift by a fixed number of years; site 3 has no year at all
    odd = t.withColumn("env20", F.when(F.col("site") == 3, F.col("location")).otherwise(F.concat("location", F.lit("_"), (F.col("year") + 20).cast("string"))))
    return R.filter_years(odd, 2017, 2019, "env20").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("f3_feature_view", "F3", WITH_META + "select id, env, l_quantity, l_discount, c_mktsegment from meta")
def _(spark, sf):
    schema = TrialSchema(env_numeric=("l_quantity", "l_discount"), env_categorical=("c_mktsegment",))
    return R.feature_view(FX.meta_trials(spark, sf), schema)


@query("f4_membership", "F4", WITH_TT + """select 'in' as side, count(*) as n, count(distinct hybrid) as h from te where hybrid in (select hybrid from tr)
union all select 'out', count(*), count(distinct hybrid) from te where hybrid not in (select hybrid from tr)""")
def _(spark, sf):
    tr, te = train_test(FX.meta_trials(spark, sf))
    keys = tr.select("hybrid").distinct()
    sides = [("in", R.in_set(te, keys)), ("out", R.not_in_set(te, keys))]
    return R.union_results([d.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"), F.count_distinct("hybrid").alias("h")) for n, d in sides])


@query("f5_null_profile", "F5", """select 'l_discount' as "column", count(*) as n_null from lineitem where l_discount = 0 union all select 'l_tax', count(*) from lineitem where l_tax > 0.05::double""")
def _(spark, sf):
    li = FX.table(spark, sf, "lineitem")
    li = li.withColumns({"l_discount": F.when(F.col("l_discount") != 0, F.col("l_discount")), "l_tax": F.when(F.col("l_tax") <= 0.05, F.col("l_tax"))})
    return R.null_profile(li)


@query("j1_attach_target", "J1", WITH_META + """, y as (select case when l_discount > 0.02::double then row_key else concat(row_key, '?') end as row_key, min(yield_mg) as y from trials group by 1)
select 'inner' as how, count(*) as n, round(sum(y), 6) as total from meta join y using (row_key)
union all select 'left', count(*), round(sum(y), 6) from meta left join y using (row_key)""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    renamed = F.when(F.col("l_discount") > 0.02, F.col("row_key")).otherwise(F.concat("row_key", F.lit("?")))
    y = t.groupBy(renamed.alias("row_key")).agg(F.min("yield_mg").alias("y"))
    x = t.drop("yield_mg")
    out = [R.attach_target(x, y, how, "row_key").agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 6).alias("total")) for how in ("inner", "left")]
    return R.union_results(out)


def two_sides(t):
    """The trials twice, with some hybrids named so that they are on one side only."""
    named = lambda c, tag: t.withColumn("hybrid", F.when(F.col(c) > 0.01, F.col("hybrid")).otherwise(F.concat("hybrid", F.lit(tag))))
    return named("l_discount", "x"), named("l_tax", "y")


@query("j2_align_pairs", "J2", WITH_META + """, x as (select env, case when l_discount > 0.01::double then hybrid else concat(hybrid, 'x') end as hybrid, count(*) as c from trials group by all),
y as (select env, case when l_tax > 0.01::double then hybrid else concat(hybrid, 'y') end as hybrid, count(*) as c from trials group by all),
f as (select case when y.c is null then 'only_x' when x.c is null then 'only_y' when x.c <> y.c then 'row_count_differs' else 'aligned' end as status,
 coalesce(x.c, 0) as cx, coalesce(y.c, 0) as cy from x full join y on x.env = y.env and x.hybrid = y.hybrid)
select status, count(*) as n_keys, cast(sum(cx) as bigint) as rows_x, cast(sum(cy) as bigint) as rows_y from f group by status""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    return R.align_pairs(*two_sides(t))[2]


@query("j2_aligned_rows", "J2", WITH_META + """, x as (select * replace (case when l_discount > 0.01::double then hybrid else concat(hybrid, 'x') end as hybrid) from trials), y as (select * replace (case when l_tax > 0.01::double then hybrid else concat(hybrid, 'y') end as hybrid) from trials)
select 'x' as side, count(*) as n from x where (env, hybrid) in (select (env, hybrid) from y) union all
select 'y', count(*) from y where (env, hybrid) in (select (env, hybrid) from x)""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    x, y, _ = R.align_pairs(*two_sides(t))
    return R.union_results([d.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n")) for s, d in (("x", x), ("y", y))])


CELL_SQL = ", cell as (select env, id, avg(actual) as actual, avg(m_a) as m_a, avg(m_b) as m_b, avg(m_c) as m_c, avg(m_d) as m_d from pred group by env, id)"


def cells(spark, sf):
    """Unique (env, id) rows: means over replicated plots."""
    return pred(spark, sf).groupBy("env", "id").agg(*[F.avg(c).alias(c) for c in ("actual", *FX.MODELS)])


def long_predictions(df, models=None):
    """One row per key and model; each model leaves out some keys so that the merge has work to do."""
    models = models or FX.MODELS
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models]))
    return df.select("env", "id", "actual", pairs.alias("p")).select("env", "id", "actual", "p.model", "p.pred")


@query("j3_merge_predictions", "J3", WITH_PRED + CELL_SQL + f""" select env, id, {q6('actual', 9)} as actual, {q6('m_a', 9)} as m_a, {q6('m_b', 9)} as m_b, {q6('m_c', 9)} as m_c
from cell where not (right(id, 1) = '3' and env like '%8')""")
def _(spark, sf):
    long = long_predictions(cells(spark, sf), ["m_a", "m_b", "m_c"])
    apart = (F.col("model") == "m_b") & F.col("id").endswith("3") & F.col("env").endswith("8")
    long = long.withColumn("id", F.when(apart, F.concat("id", F.lit("?"))).otherwise(F.col("id")))
    return rounded(SP.merge_predictions(long), 9)


@query("j4_attach_effects", "J4", WITH_META + f""", u as (select * from meta where year <= 1999), mu as (select avg(yield_mg) as mu from u),
yr as (select year, avg(yield_mg) as my from u group by year), g as (select hybrid, avg(yield_mg - my) as g from u join yr using (year) group by hybrid),
e as (select u.env, avg(yield_mg) - max(my) - avg(g) as e from u join yr using (year) join g using (hybrid) group by u.env)
select row_key, {q6('coalesce(my, mu)')} as mu_year, {q6('coalesce(g,0)')} as g_hat, {q6('coalesce(e,0)')} as e_hat, g is not null as has_g_hat, e is not null as has_e_hat,
{q6('yield_mg - coalesce(my, mu) - coalesce(g,0) - coalesce(e,0)')} as ge_hat
from meta left join yr using (year) left join g using (hybrid) left join e using (env), mu""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    out = E.attach_effects(t, E.fit_effects(t, train_max=1999))
    return rounded(out.select("row_key", "mu_year", "g_hat", "e_hat", "has_g_hat", "has_e_hat", "ge_hat"))


@query("j5_compare_submissions", "J5", WITH_PRED + CELL_SQL + f""", p as (
 select 'm_a' as first, 'm_b' as second, m_a as x, m_b as y from cell union all select 'm_a', 'm_d', m_a, m_d from cell union all select 'm_b', 'm_d', m_b, m_d from cell)
select first, second, count(*) as n, {q6('regr_sxy(y,x)/(sqrt(regr_sxx(y,x))*sqrt(regr_syy(y,x)))')} as pcc, {q6('regr_sxy(y,x)/regr_sxx(y,x)')} as slope,
{q6('avg(y)-regr_sxy(y,x)/regr_sxx(y,x)*avg(x)')} as intercept from p group by all""")
def _(spark, sf):
    c = cells(spark, sf)
    subs = {m: c.select("env", "id", F.col(m).alias("pred")) for m in ("m_a", "m_b", "m_d")}
    return rounded(R.compare_submissions(subs, ["env", "id"]))


@query("j6_pairs_within", "J6", WITH_META + f""", o as (select hybrid, row_key, yield_mg, lag(env) over (partition by hybrid order by yield_mg, row_key) as pe, row_number() over (partition by hybrid order by yield_mg, row_key) as pos from trials)
select hybrid, count(*) as n_rows, cast(count(*)*(count(*)-1)//2 as bigint) as n_pairs, {q6('sum(yield_mg*(2*pos-1)) - sum(yield_mg)*count(*)')} as gap_sum from o group by hybrid""")
def _(spark, sf):
    return PJ.ordered_pair_summary(FX.trials(spark, sf), "hybrid", "yield_mg", "row_key").withColumn("gap_sum", r6("gap_sum"))


@query("u1_novel_keys", "U1", WITH_TT + "select distinct hybrid from te where hybrid not in (select hybrid from tr)")
def _(spark, sf):
    tr, te = train_test(FX.meta_trials(spark, sf))
    return R.novel_keys(te, tr, "hybrid")


@query("u2_shared_keys", "U2", WITH_TT + "select distinct location, parent2 from te where (location, parent2) in (select (location, parent2) from tr)")
def _(spark, sf):
    tr, te = train_test(FX.meta_trials(spark, sf))
    return R.shared_keys(te, tr, ["location", "parent2"])


@query("u3_all_parents", "U3", WITH_META + "select parent1 as parent from meta union select parent2 from meta")
def _(spark, sf):
    return R.all_parents(FX.meta_trials(spark, sf))


@query("u4_union_results", "U4", WITH_TT + "select 'train' as part, location, count(*) as n from tr group by location union all select 'test', location, count(*) from te group by location")
def _(spark, sf):
    tr, te = train_test(FX.meta_trials(spark, sf))
    return R.union_results([d.groupBy(F.lit(p).alias("part"), "location").agg(F.count(F.lit(1)).alias("n")) for p, d in (("train", tr), ("test", te))])
