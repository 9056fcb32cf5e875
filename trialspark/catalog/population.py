"""Population, novelty and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, WITH_TT, pred, q6, rounded, train_test
from trialspark.catalog.splits import FIRST, SIBS
from trialspark.operators import population as P
from trialspark.operators import relations as R
from trialspark.shared import materialize


def tt(spark, sf):
    return train_test(FX.meta_trials(spark, sf))


@query("w1_first_seen", "W1", WITH_META + "select parent1, min(year) as first_year, max(year) as last_year from meta group by parent1")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    return P.first_seen(t, "parent1").join(P.last_seen(t, "parent1"), "parent1")


@query("w1_last_train_year", "W1", WITH_TT + "select last_year, count(*) as n_keys from (select hybrid, max(year) as last_year from tr where hybrid in (select hybrid from te) group by hybrid) group by last_year")
def _(spark, sf):
    return P.last_train_year_of_shared(*tt(spark, sf))


@query("l1_top_values", "L1", WITH_META + "select parent1, count(*) as n from meta group by parent1 order by n desc, parent1 limit 10")
def _(spark, sf):
    return R.top_values(FX.meta_trials(spark, sf), "parent1", 10)


@query("l2_top_testers_by_year", "L2", WITH_META + FIRST + f""", h as (select distinct hybrid, parent2, fy from meta join fh using (hybrid)), c as (select fy as year, parent2, count(*) as n, row_number() over (partition by fy order by count(*) desc, parent2) as rank from h group by fy, parent2)
select year, cast(rank as integer) as rank, parent2 as tester, n, {q6('100.0*n/(select count(*) from h where fy = year)')} as pct from c where rank <= 3""")
def _(spark, sf):
    return rounded(P.top_testers_by_year(FX.meta_trials(spark, sf), 3))


@query("a1_hybrid_novelty", "A1", WITH_TT + f""", x as (select (select count(distinct hybrid) from tr) as n_train, (select count(distinct hybrid) from te) as n_test, (select count(distinct hybrid) from te where hybrid in (select hybrid from tr)) as n_shared,
 (select count(distinct hybrid) from te where hybrid not in (select hybrid from tr)) as n_novel, (select count(*) from te) as test_rows, (select count(*) from te where hybrid not in (select hybrid from tr)) as novel_rows)
select *, {q6('100.0*n_novel/n_test')} as pct_novel, {q6('100.0*novel_rows/test_rows')} as pct_novel_rows from x""")
def _(spark, sf):
    return rounded(P.hybrid_novelty(*tt(spark, sf)))


@query("a2_env_novelty", "A2", WITH_TT + " union all ".join(f"""select '{k}' as level, (select count(distinct {k}) from tr) as n_train, (select count(distinct {k}) from te) as n_test,
(select count(distinct {k}) from te where {k} in (select {k} from tr)) as n_shared, (select count(distinct {k}) from te where {k} not in (select {k} from tr)) as n_novel""" for k in ("env", "location")))
def _(spark, sf):
    return P.env_novelty(*tt(spark, sf))


@query("a3_location_coverage", "A3", WITH_TT + """select location, count(distinct y) as n_years, coalesce(string_agg(distinct cast(y as varchar), ',' order by cast(y as varchar)), '') as years
from (select distinct location from te) left join (select case when location like '%3' then concat(location, '_OLD') else location end as l, year as y from tr) on location = l group by location""")
def _(spark, sf):
    tr, te = tt(spark, sf)
    return P.location_coverage(tr.withColumn("location", F.when(F.col("location").endswith("3"), F.concat("location", F.lit("_OLD"))).otherwise(F.col("location"))), te)


NOV = """select m.year, count(distinct {k}) as n_keys, count(distinct case when fy = m.year then {k} end) as n_novel, count(case when fy = m.year then 1 end) as novel_rows,
{p} as novelty_pct from meta m join (select {k}, min(year) as fy from meta group by {k}) using ({k}) where m.year > (select min(year) from meta) group by m.year"""


@query("a4_novelty_by_year", "A4", WITH_META + NOV.format(k="hybrid", p=q6("100.0*count(distinct case when fy = m.year then hybrid end)/count(distinct hybrid)")))
def _(spark, sf):
    return rounded(P.novelty_by_year(FX.meta_trials(spark, sf)))


@query("a5_turnover", "A5", WITH_META + f""", d as (select distinct year, hybrid from meta), y as (select year, lag(year) over (order by year) as prev_year from (select distinct year from d))
select prev_year, y.year, (select count(*) from d where d.year = prev_year) as n_prev, count(*) as n, count(p.hybrid) as n_shared, {q6('100.0*count(p.hybrid)/count(*)')} as pct_shared
from y join d on d.year = y.year left join d p on p.year = prev_year and p.hybrid = d.hybrid where prev_year is not null group by prev_year, y.year""")
def _(spark, sf):
    return rounded(P.turnover(FX.meta_trials(spark, sf)))


@query("a6_overlap_by_year", "A6", WITH_TT + f"""select year, count(*) as n_rows, count(distinct hybrid) as n_hybrids, count(distinct location) as n_locations, count(distinct case when hybrid in (select hybrid from te) then hybrid end) as hybrid_overlap,
count(distinct case when location in (select location from te) then location end) as location_overlap, {q6('100.0*count(distinct case when hybrid in (select hybrid from te) then hybrid end)/count(distinct hybrid)')} as pct_hybrid_overlap from tr group by year""")
def _(spark, sf):
    return rounded(P.overlap_by_year(*tt(spark, sf)))


@query("a7_yield_by_year", "A7", WITH_META + f"select year, {q6('avg(yield_mg)')} as mean, {q6('stddev_samp(yield_mg)')} as std, count(*) as n from (select year, case when l_discount > 0 then yield_mg end as yield_mg from meta) group by year")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    return rounded(P.yield_by_year(t.withColumn("yield_mg", F.when(F.col("l_discount") > 0, F.col("yield_mg")))))


@query("a8_within_env_std", "A8", WITH_META + f", s as (select year, env, stddev_samp(yield_mg) as sd from meta group by all) select year, {q6('median(sd)')} as median_std, {q6('avg(sd)')} as mean_std, count(sd) as n_envs from s group by year")
def _(spark, sf):
    return rounded(P.within_env_std(FX.meta_trials(spark, sf)))


@query("a9_lifespan_hist", "A9", WITH_META + f", s as (select hybrid, count(distinct year) as n_years from meta group by hybrid) select n_years, count(*) as n_keys, {q6('100.0*count(*)/(select count(*) from s)')} as pct from s group by n_years")
def _(spark, sf):
    return rounded(P.lifespan_hist(FX.meta_trials(spark, sf)))


@query("a10_parent_novelty", "A10", WITH_TT + f""", pa as (select parent1 as p from tr union select parent2 from tr), pb as (select parent1 as p from te union select parent2 from te),
nv as (select * from te where hybrid not in (select hybrid from tr)), k as (select hybrid, parent1 in (select p from pa) as k1, parent2 in (select p from pa) as k2 from nv)
select (select count(*) from pa) as parents_train, (select count(*) from pb) as parents_test, (select count(*) from pb where p in (select p from pa)) as parents_shared, (select count(*) from pb where p not in (select p from pa)) as parents_novel,
count(distinct hybrid) as n_novel_hybrids, {q6('100.0*avg(k1::int)')} as pct_known_p1, {q6('100.0*avg(k2::int)')} as pct_known_p2, {q6('100.0*avg((k1 or k2)::int)')} as pct_any, {q6('100.0*avg((k1 and k2)::int)')} as pct_both from k""")
def _(spark, sf):
    return rounded(P.parent_novelty(*tt(spark, sf)))


@query("a11_top_parents", "A11", WITH_TT + """, pa as (select parent1 as p from tr union select parent2 from tr), a as (select parent1 as parent, count(*) as n from te group by 1 order by n desc, parent limit 10), b as (select parent2 as parent, count(*) as n from te group by 1 order by n desc, parent limit 10)
select 'parent1' as role, parent, n, case when parent in (select p from pa) then 'KNOWN' else 'NOVEL' end as status from a union all select 'parent2', parent, n, case when parent in (select p from pa) then 'KNOWN' else 'NOVEL' end from b""")
def _(spark, sf):
    return P.top_parents(*tt(spark, sf))


PFIRST = ", pf as (select p, min(year) as py from (select parent1 as p, year from meta union all select parent2, year from meta) where p <> '' group by p)"


@query("a12_novelty_trajectory", "A12", WITH_META + FIRST + PFIRST + f""", r as (select m.*, fy = m.year as nov, coalesce(a.py < m.year, false) as k1, coalesce(b.py < m.year, false) as k2 from meta m join fh using (hybrid) left join pf a on a.p = parent1 left join pf b on b.p = parent2)
select year, count(distinct hybrid) as n_hybrids, {q6('100.0*count(distinct case when nov then hybrid end)/count(distinct hybrid)')} as novelty_pct, {q6('coalesce(100.0*avg(case when nov then k1::int end), 0)')} as pct_known_p1,
{q6('coalesce(100.0*avg(case when nov then (k1 and k2)::int end), 0)')} as pct_both_known, count(distinct env) as n_envs from r where year > (select min(year) from meta) group by year""")
def _(spark, sf):
    return rounded(P.novelty_trajectory(FX.meta_trials(spark, sf)))


@query("a13_training_volume", "A13", WITH_META + f""", x as (select count(*) as rows_all, count(case when year < 1999 then 1 end) as rows_before, count(distinct hybrid) as hybrids_all, count(distinct case when year < 1999 then hybrid end) as hybrids_before from meta)
select *, {q6('100.0*(rows_all-rows_before)/rows_all')} as pct_rows_lost, {q6('100.0*(hybrids_all-hybrids_before)/hybrids_all')} as pct_hybrids_lost from x""")
def _(spark, sf):
    return rounded(P.training_volume(FX.meta_trials(spark, sf), 1999))


@query("a14_half_sib_counts", "A14", WITH_META + SIBS + " select * from sib")
def _(spark, sf):
    return P.half_sib_counts(FX.meta_trials(spark, sf))


PROFILE = f"""select year, count(*) as n_novel, {q6('avg(n_half_sibs)')} as mean_sibs, median(n_half_sibs)::double as median_sibs, min(n_half_sibs) as min_sibs, max(n_half_sibs) as max_sibs,
{q6('100.0*count(case when n_half_sibs = 0 then 1 end)/count(*)')} as pct_zero, {q6('100.0*count(case when n_half_sibs < 10 then 1 end)/count(*)')} as pct_below_10, {q6('100.0*count(case when n_half_sibs > 100 then 1 end)/count(*)')} as pct_above_100,
{q6('100.0*count(case when n_half_sibs > 0 then 1 end)/count(*)')} as pct_connected, {q6('sum(n_half_sibs)/nullif(count(case when n_half_sibs > 0 then 1 end), 0)')} as mean_connected from sib"""


@query("a14_half_sib_profile", "A14", WITH_META + SIBS + PROFILE + " group by year")
def _(spark, sf):
    return rounded(P.half_sib_profile(FX.meta_trials(spark, sf)))


@query("a15_half_sib_rate", "A15", WITH_META + FIRST + PFIRST + f""", hy as (select distinct hybrid, parent1, parent2, fy as year from meta join fh using (hybrid)),
r as (select year, count(*) as n_novel, {q6('100.0*avg((coalesce(a.py < year, false) or coalesce(b.py < year, false))::int)')} as half_sib_pct from hy left join pf a on a.p = parent1 left join pf b on b.p = parent2 group by year),
s as (select m.year, {q6('avg(yield_mg)')} as yield_mean, {q6('stddev_samp(yield_mg)')} as yield_std from meta m join fh using (hybrid) where fy = m.year group by m.year),
tl as (select distinct case when location like '%7' then concat(location, '_NEW') else location end as location from meta where year = 2001)
select l.year, n_novel, half_sib_pct, yield_mean, yield_std, n_locations, shared_locations, (select count(*) from tl) as test_locations from
(select year, count(distinct location) as n_locations, count(distinct case when location in (select location from tl) then location end) as shared_locations from meta where year in (1996, 1998, 2000, 2001) group by year) l join r using (year) join s using (year)""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    test = t.filter("year = 2001").withColumn("location", F.when(F.col("location").endswith("7"), F.concat("location", F.lit("_NEW"))).otherwise(F.col("location")))
    return rounded(P.half_sib_rate(t, [1996, 1998, 2000, 2001], test))


@query("a16_tester_support", "A16", WITH_TT + """, tx as (select * replace (case when parent2 = 'T3' then 'T9' else parent2 end as parent2) from tr), nv as (select parent2, count(distinct hybrid) as n_novel from te where hybrid not in (select hybrid from tx) and parent2 <> '' group by parent2)
select nv.parent2 as tester, n_novel, count(distinct hybrid) as n_train_hybrids, count(hybrid) as n_rows, count(distinct year) as n_years, count(distinct env) as n_envs from nv left join tx using (parent2) group by all""")
def _(spark, sf):
    tr, te = tt(spark, sf)
    return P.tester_support(tr.withColumn("parent2", F.when(F.col("parent2") == "T3", "T9").otherwise(F.col("parent2"))), te)


@query("a17_difficulty_profile", "A17", WITH_META + SIBS + f""", nv as (select m.* from meta m join fh using (hybrid) where fy = 1999 and year = 1999), p as ({PROFILE} where year = 1999 group by year)
select p.*, {q6('y')} as yield_mean, {q6('s')} as yield_std, {q6('100.0*s/y')} as yield_cv, n_envs, median_rows_per_env from p, (select avg(yield_mg) as y, stddev_samp(yield_mg) as s from nv),
(select count(*) as n_envs, median(n)::double as median_rows_per_env from (select env, count(*) as n from nv group by env))""")
def _(spark, sf):
    return rounded(P.difficulty_profile(FX.meta_trials(spark, sf), 1999))


def hybrid_markers(spark, sf):
    """Plots per year and hybrid with the hybrid's markers: dense code modulo the number of vectors."""
    from trialspark.operators import features as T

    t = materialize(FX.meta_trials(spark, sf).groupBy("year", "hybrid", "parent1", "parent2").agg(F.count(F.lit(1)).alias("n")))
    m = FX.markers(spark, sf).select("vec_id", "markers")
    codes = T.category_codes(t, "hybrid", "code").join(F.broadcast(m.agg(F.count(F.lit(1)).alias("nv"))))  # one-row total
    by_hybrid = codes.withColumn("vec_id", F.col("code") % F.col("nv")).join(m, "vec_id").select("hybrid", "markers")
    return t.join(by_hybrid, "hybrid")


SQL_HM = WITH_META.rstrip() + ",\n" + FX.SQL_MARKERS + FIRST + """,
code as (select hybrid, (row_number() over (order by hybrid) - 1) % (select count(*) from markers) as vec_id from fh),
lm as (select vec_id, unnest(markers) as x, unnest(range(len(markers))) as marker from markers),
hm as (select m.year, m.hybrid, fy, vec_id from meta m join fh using (hybrid) join code using (hybrid)),
sets as (select case when year < 2000 then 'a_train' when year = 2000 then 'b_novel2000' else 'c_novel2001' end as s, vec_id from hm where year < 2000 or fy = year),
fr as (select s, marker, sum(x*n)/sum(n) as f from (select s, vec_id, count(*) as n from sets group by all) join lm using (vec_id) group by all),
pr as (select a.s as set_a, b.s as set_b, a.f as fa, b.f as fb from fr a join fr b on a.marker = b.marker and a.s < b.s)
"""


def marker_sets(spark, sf):
    hm = hybrid_markers(spark, sf)
    first = P.first_seen(hm, "hybrid")
    label = F.when(F.col("year") < 2000, "a_train").when(F.col("year") == 2000, "b_novel2000").otherwise("c_novel2001")
    keep = (F.col("year") < 2000) | (F.col("first_year") == F.col("year"))
    return hm.join(first, "hybrid").filter(keep).withColumn("population", label)


@query("a18_centroid_distance", "A18", SQL_HM + f"select set_a, set_b, {q6('1 - sum(fa*fb)/(sqrt(sum(fa*fa))*sqrt(sum(fb*fb)))')} as cosine_distance from pr group by all")
def _(spark, sf):
    return rounded(P.centroid_distance(marker_sets(spark, sf), "population", weight="n"))


@query("a19_af_shift", "A19", SQL_HM + f"""select set_a, set_b, count(*) as n_markers, {q6('regr_sxy(fb,fa)/(sqrt(regr_sxx(fb,fa))*sqrt(regr_syy(fb,fa)))')} as pcc,
count(case when abs(fa-fb) > 0.1::double then 1 end) as n_shift_small, count(case when abs(fa-fb) > 0.2::double then 1 end) as n_shift_large from pr group by all""")
def _(spark, sf):
    return rounded(P.af_shift(marker_sets(spark, sf), "population", weight="n"))


DRIFT = ", lf as (select year, location, feature, avg(v) as v from (select year, location, unnest(['q','d','t']) as feature, unnest([l_quantity, l_discount, l_tax]) as v from meta) group by all)"


@query("a20_covariate_drift_chain", "A20", WITH_META + DRIFT + f""", d as (select a.year, a.location, avg(abs(a.v-b.v)) as d from lf a join lf b on b.year = a.year + 1 and a.location = b.location and a.feature = b.feature group by all)
select year, year + 1 as other_year, count(*) as n_locations, {q6('avg(d)')} as mean_diff, {q6('stddev_pop(d)')} as std_diff, {q6('max(d)')} as max_diff from d group by year""")
def _(spark, sf):
    return rounded(P.covariate_drift_chain(FX.meta_trials(spark, sf), ["l_quantity", "l_discount", "l_tax"]))


@query("a20_covariate_drift", "A20", WITH_META + DRIFT + f""", d as (select a.location, avg(abs(a.v-b.v)) as d from lf a join lf b on a.year = 1996 and b.year = 2001 and a.location = b.location and a.feature = b.feature group by all)
select 1996 as year, 2001 as other_year, count(*) as n_locations, {q6('avg(d)')} as mean_diff, {q6('stddev_pop(d)')} as std_diff, {q6('max(d)')} as max_diff from d""")
def _(spark, sf):
    return rounded(P.covariate_drift(FX.meta_trials(spark, sf), 2001, 1996, ["l_quantity", "l_discount", "l_tax"]))


@query("a21_env_yield_stats", "A21", WITH_META + FIRST + f" select env, {q6('avg(yield_mg)')} as mean, {q6('stddev_samp(yield_mg)')} as std, count(*) as n from meta m join fh using (hybrid) where fy = m.year group by env having count(*) >= 40")
def _(spark, sf):
    return rounded(P.env_yield_stats(FX.meta_trials(spark, sf), 40))


@query("a22_fold_similarity", "A22", SQL_HM.rstrip() + f""", hy as (select distinct hybrid, parent1, parent2, fy as year from meta join fh using (hybrid)), tgt as (select * from hy where year = 2001),
nn as (select year, count(*) as n_novel from hy where year < 2001 and year > (select min(year) from meta) group by year having count(*) >= 5), na as (select year, count(distinct hybrid) as n_all from meta group by year),
ov as (select year, count(distinct case when parent2 in (select parent2 from tgt) then parent2 end) as tester_overlap, count(distinct case when parent1 in (select parent1 from tgt) then parent1 end) as p1_overlap from hy group by year),
f2 as (select year, marker, sum(x*n)/sum(n) as f from (select year, vec_id, count(*) as n from hm where fy = year group by all) join lm using (vec_id) group by all),
af as (select a.year, count(*) as m, count(case when abs(a.f-r.f) > 0.1::double then 1 end) as n_shift, regr_sxy(r.f,a.f)/(sqrt(regr_sxx(r.f,a.f))*sqrt(regr_syy(r.f,a.f))) as af_pcc from f2 a join f2 r on r.year = 2001 and r.marker = a.marker where a.year < 2001 group by a.year)
select year, n_novel, {q6('100.0*n_novel/n_all')} as novelty_pct, tester_overlap, p1_overlap, {q6('af_pcc')} as af_pcc, n_shift,
{q6('0.3::double*least(100.0*n_novel/n_all/90, 1) + 0.2::double*tester_overlap/(select count(distinct parent2) from tgt) + 0.2::double*greatest(0, af_pcc) + 0.15::double*p1_overlap/(select count(distinct parent1) from tgt) + 0.15::double*greatest(0, 1 - n_shift::double/m)')} as score
from nn join na using (year) join ov using (year) join af using (year)""")
def _(spark, sf):
    return rounded(P.fold_similarity(hybrid_markers(spark, sf), 2001, weight="n"))


@query("a23_yield_by_env", "A23", WITH_META + f"select env, {q6('avg(1.5::double*(0.7::double*yield_mg+0.3::double*l_quantity)+4)')} as mean_pred from meta group by env")
def _(spark, sf):
    return rounded(P.yield_by_env(pred(spark, sf)))
