"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, q6, rounded
from trialspark.operators import relations as R
from trialspark.operators import splits as D

Y = FX.TEST_YEAR
TT = FX.TEST_TESTERS

LEO_ENVS = """, pool as (select distinct env from meta where year < 2001),
leo as (select env from (select env, row_number() over (order by md5(concat('42', ':', env)), env) as k from pool) where k <= (select greatest(1, floor(count(*)*0.15)) from pool))"""
PROXY = """, fy as (select parent1, min(year) as stratum from meta where year < 2001 and parent2 = 'T1' group by parent1),
pk as (select parent1, stratum from (select *, row_number() over (partition by stratum order by md5(concat('1', ':', parent1)), parent1) as k, count(*) over (partition by stratum) as n from fy)
 where k <= least(n, greatest(1, cast(round_even(n*0.2::double, 0) as bigint)))),
px as (select *, case when year >= 2001 then 'test' when parent2 = 'T1' and parent1 in (select parent1 from pk) then 'val' else 'train' end as split from meta)"""
LYGO = """, seen as (select distinct {key} from meta where year < 2000),
cand as (select * from meta where year = 2000 and parent2 in ('T1','T2') and {key} not in (select {key} from seen)),
ok as (select env from cand group by env having count(*) >= {m})"""


def count_by(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("d1_split_by_year", "D1", WITH_META + "select year, case when year <= 1999 then 'train' when year = 2000 then 'val' when year >= 2001 then 'test' end as split, count(*) as n from meta group by all")
def _(spark, sf):
    return count_by(D.split_by_year(FX.meta_trials(spark, sf), 1999, 2000, 2001), "year", "split")


@query("d2_split_leo", "D2", WITH_META + LEO_ENVS + " select env, case when year >= 2001 then 'test' when env in (select env from leo) then 'val' else 'train' end as split, count(*) as n from meta group by all")
def _(spark, sf):
    return count_by(D.split_leo(FX.meta_trials(spark, sf), test_year=Y), "env", "split")


@query("d3_split_proxy_tester", "D3", WITH_META + PROXY + " select parent1, parent2, split, count(*) as n from px group by all")
def _(spark, sf):
    return count_by(D.split_proxy_tester(FX.meta_trials(spark, sf), "T1", test_year=Y), "parent1", "parent2", "split")


@query("d4_split_proxy_disjoint", "D4", WITH_META + LEO_ENVS + PROXY + """ select env, case when split = 'val' and env in (select env from leo) then 'excluded' else split end as split, count(*) as n from px group by all""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    return count_by(D.split_proxy_tester(t, "T1", test_year=Y, leo_envs=D.leo_val_envs(t, test_year=Y)), "env", "split")


@query("d5_proxy_diagnostics", "D5", WITH_META + LEO_ENVS + PROXY + f""", q as (select *, case when split = 'val' and env in (select env from leo) then 'excluded' else split end as s2 from px where year < 2001),
hp as (select distinct parent1 from q where s2 = 'val'), x as (select
 (select count(*) from hp where parent1 in (select parent1 from q where parent2 <> 'T1'))::double / (select count(*) from hp) as f, (select count(*) from q where s2 = 'excluded') as r)
select year, count(*) as n_rows, count(distinct hybrid) as n_hybrids, count(distinct env) as n_envs, count(distinct parent1) as n_parents, {q6('max(f)')} as parent_other_tester_frac, max(r) as n_removed
from q, x where s2 = 'val' group by grouping sets ((year), ())""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    split = D.split_proxy_tester(t, "T1", test_year=Y, leo_envs=D.leo_val_envs(t, test_year=Y))
    return rounded(D.proxy_diagnostics(split, "T1", Y))


@query("d5_proxy_strata", "D5", WITH_META + PROXY + " select stratum, count(*) as n_picked from pk group by stratum")
def _(spark, sf):
    return D.proxy_parents(FX.meta_trials(spark, sf), "T1", test_year=Y).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_picked"))


@query("d6_test_testers", "D6", WITH_META + "select distinct parent2 as tester from meta where year = 2001 and parent2 <> ''")
def _(spark, sf):
    return D.test_testers(FX.meta_trials(spark, sf), Y)


def _lygo_sql(key, m):
    return WITH_META + LYGO.format(key=key, m=m) + f""" select env, case when year < 2000 then 'train' when row_key in (select row_key from cand where env in (select env from ok)) then 'val' end as split, count(*) as n from meta group by all"""


@query("d7_split_lygo", "D7", _lygo_sql("parent1", 4))
def _(spark, sf):
    return count_by(D.split_lygo(FX.meta_trials(spark, sf), 2000, TT), "env", "split")


@query("d7_split_lygo_hybrid", "D7", _lygo_sql("hybrid", 22))
def _(spark, sf):
    return count_by(D.split_lygo(FX.meta_trials(spark, sf), 2000, TT, "hybrid", 22), "env", "split")


@query("d8_lygo_diagnostics", "D8", WITH_META + LYGO.format(key="parent1", m=25) + """, ec as (select env, count(*) as n from cand group by env), kept as (select * from cand where env in (select env from ok))
select (select count(*) from kept) as n_val_rows, (select count(*) from ok) as n_val_envs, (select coalesce(min(n), 0) from ec where n >= 25) as rows_per_env_min,
 (select coalesce(median(n), 0)::double from ec where n >= 25) as rows_per_env_median, (select count(*) from ec where n < 25) as n_envs_dropped, (select count(*) from ec where n < 4) as n_envs_below_4,
 (select count(distinct parent1) from kept) as n_val_parents, (select count(distinct hybrid) from kept) as n_val_hybrids, (select count(*) from meta where year < 2000) as train_rows,
 (select count(distinct parent1) from meta where year < 2000) as train_parents, (select string_agg(distinct cast(year as varchar), ',' order by cast(year as varchar)) from meta where year < 2000) as train_years,
 0 as overlap_parents, (select count(*) from meta where year = 2000) as year_rows, 'T9' as testers_missing,
 concat_ws(',', case when (select count(*) from kept) < 200 then 'few_rows' end, case when (select count(*) from ok) < 5 then 'few_envs' end) as warnings""")
def _(spark, sf):
    return D.lygo_diagnostics(FX.meta_trials(spark, sf), 2000, TT, min_val_per_env=25, test_tester_names=["T1", "T2", "T9"])


FIRST = ", fh as (select hybrid, min(year) as fy from meta group by hybrid)"


@query("d9_lyngo_sizes", "D9", WITH_META + FIRST + f""", nv as (select m.year, env, count(*) as n from meta m join fh using (hybrid) where fy = m.year group by all)
select y.year, coalesce(n_rows, 0) as n_rows, coalesce(n_envs, 0) as n_envs, coalesce(n_envs_usable, 0) as n_envs_usable, {q6('100.0*nh/h')} as novelty_pct from
(select m.year, count(distinct hybrid) as h, count(distinct case when fy = m.year then hybrid end) as nh from meta m join fh using (hybrid) where m.year between 1996 and 2001 group by m.year) y
left join (select year, cast(sum(n) as bigint) as n_rows, count(*) as n_envs, count(case when n >= 20 then 1 end) as n_envs_usable from nv group by year) using (year)""")
def _(spark, sf):
    return rounded(D.lyngo_sizes(FX.meta_trials(spark, sf), list(range(1996, 2002)), 20))


@query("d10_rolling_folds", "D10", WITH_META + """, f as (select * from (values (0, 1999, 2000), (1, 1998, 1999), (2, 1997, 1998)) t(fold_idx, train_year_max, val_year))
select fold_idx, train_year_max, val_year, case when year = val_year then 'val' else 'train' end as role, count(*) as n from meta join f on year <= val_year group by all""")
def _(spark, sf):
    folds = D.fold_table(spark, 1995, 2000, recent_first=True, max_folds=3)
    return count_by(D.rolling_folds(FX.meta_trials(spark, sf), folds), "fold_idx", "train_year_max", "val_year", "role")


@query("d11_split_random", "D11", WITH_META + """select env, case when (cast('0x' || substr(md5(concat('42', ':', row_key)), 1, 12) as bigint) + 0.5::double)/281474976710656 < 0.8 then 'train' else 'val' end as split, count(*) as n from meta group by all""")
def _(spark, sf):
    return count_by(D.split_random(FX.meta_trials(spark, sf)), "env", "split")


@query("d12_cross_tester_holdout", "D12", WITH_META + f""", s as (select * replace (case when parent1 < 'P060' and parent2 <> 'T1' then concat(parent1, 'x') else parent1 end as parent1) from meta), c as (select distinct parent1, parent2, hybrid from s), pp as (select parent1, count(case when parent2 = 'T1' then 1 end) as wt, count(case when parent2 <> 'T1' then 1 end) as wo from c group by parent1),
hd as (select * from s where parent2 = 'T1' and parent1 in (select parent1 from pp where wt = 1))
select 'T1' as tester, cast(sum(wt) as bigint) as n_tester_hybrids, count(case when wt = 1 then 1 end) as n_single_parents, count(case when wt > 1 then 1 end) as n_multi_parents,
count(case when wt = 1 and wo > 0 then 1 end) as n_supported, (select count(distinct hybrid) from hd) as n_holdout_hybrids, (select count(*) from hd) as n_holdout_rows, (select count(distinct env) from hd) as n_holdout_envs,
{q6('100.0*count(case when wt = 1 and wo > 0 then 1 end)/greatest(count(case when wt = 1 then 1 end), 1)')} as pct_supported from pp""")
def _(spark, sf):
    # some parents meet only this tester, so support is neither 0 nor 100 %
    other = (F.col("parent1") < "P060") & (F.col("parent2") != "T1")
    t = FX.meta_trials(spark, sf).withColumn("parent1", F.when(other, F.concat("parent1", F.lit("x"))).otherwise(F.col("parent1")))
    return rounded(D.cross_tester_holdout(t, "T1"))


@query("d13_tester_by_year", "D13", WITH_META + "select year, parent2 as tester, count(*) as n_rows, count(distinct hybrid) as n_hybrids from meta where parent2 in ('T1','T2') group by all")
def _(spark, sf):
    return D.tester_by_year(FX.meta_trials(spark, sf), TT)


def _d14_sql(known):
    return WITH_META + FIRST + f""", kn as ({known}), nv as (select distinct hybrid, parent1, fy as year from meta join fh using (hybrid) where fy in (1997, 1999, 2001))
select year, count(*) as n_novel, count(distinct parent1) as n_parent1, count(distinct case when ky < year then parent1 end) as n_known_parent1, {q6('100.0*count(distinct case when ky < year then parent1 end)/count(distinct parent1)')} as pct_known
from nv left join kn using (parent1) group by year"""


@query("d14_novel_parents", "D14", _d14_sql("select p as parent1, min(year) as ky from (select parent1 as p, year from meta union all select parent2, year from meta) group by p"))
def _(spark, sf):
    return rounded(D.novel_parent_summary(FX.meta_trials(spark, sf), [1997, 1999, 2001]))


@query("d14_novel_parents_first_role", "D14", _d14_sql("select parent1, min(year) as ky from meta group by parent1"))
def _(spark, sf):
    return rounded(D.novel_parent_summary(FX.meta_trials(spark, sf), [1997, 1999, 2001], any_role=False))


SIBS = FIRST + """, hy as (select distinct hybrid, parent1, parent2, fy from meta join fh using (hybrid)),
sib as (select a.hybrid, a.fy as year, a.parent1, a.parent2, count(distinct b.hybrid) as n_half_sibs from hy a left join hy b on b.fy < a.fy and b.hybrid <> a.hybrid
 and (b.parent1 in (a.parent1, a.parent2) or b.parent2 in (a.parent1, a.parent2)) group by all)"""


@query("d15_tester_matched_years", "D15", WITH_META + SIBS + f""", tc as (select year, parent2, count(*) as c, row_number() over (partition by year order by count(*) desc, parent2) as r from sib group by year, parent2),
tx as (select year, string_agg(case when r <= 3 then concat(parent2, '(', cast(c as varchar), ')') end, ', ' order by r) as top_testers, count(case when parent2 in ('T1','T2') then 1 end) as tester_overlap from tc group by year),
ny as (select m.year, count(distinct hybrid) as nk, count(distinct case when fy = m.year then hybrid end) as nn, count(case when fy = m.year then 1 end) as nr from meta m join fh using (hybrid) group by m.year),
ms as (select year, count(*) as n_novel, avg(n_half_sibs) as mean_half_sibs from sib group by year)
select year, n_novel, {q6('100.0*nn/nk')} as novelty_pct, top_testers, tester_overlap, {q6('mean_half_sibs')} as mean_half_sibs, nr as novel_rows from ms join ny using (year) join tx using (year) where n_novel >= 5 and year > (select min(year) from meta)""")
def _(spark, sf):
    return rounded(D.tester_matched_years(FX.meta_trials(spark, sf), TT))


@query("d16_observed_mask", "D16", WITH_META + LEO_ENVS + """ select 'leo' as mode, year, count(*) as n from meta where year < 2001 and env not in (select env from leo) group by year
union all select 'plain', year, count(*) from meta where year < 2000 group by year""")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    modes = [("leo", D.observed_mask(t, D.leo_val_envs(t, test_year=Y), Y)), ("plain", D.observed_mask(t, None, Y))]
    return R.union_results([count_by(d.filter("observed"), F.lit(m).alias("mode"), "year") for m, d in modes])


@query("v9_audit_leo", "V9", WITH_META + LEO_ENVS + """, s as (select *, case when year >= 2001 then 'test' when env in (select env from leo) then 'val' else 'train' end as split from meta),
l as (select 'env' as key, env as value, split from s union all select 'hybrid', hybrid, split from s), g as (select key, value, max(split = 'train') as l, max(split = 'val') as r from l where split in ('train', 'val') group by all)
select key, count(case when l then 1 end) as n_train, count(case when r then 1 end) as n_val, count(case when l and r then 1 end) as n_shared from g group by key""")
def _(spark, sf):
    return D.audit_split(D.split_leo(FX.meta_trials(spark, sf), test_year=Y), ["env", "hybrid"])


@query("v9_audit_lygo", "V9", WITH_META + LYGO.format(key="parent1", m=4) + """, s as (select *, case when year < 2000 then 'train' when row_key in (select row_key from cand where env in (select env from ok)) then 'val' end as split from meta),
l as (select 'parent1' as key, parent1 as value, split from s union all select 'parent2', parent2, split from s union all select 'row_key', row_key, split from s), g as (select key, value, max(split = 'train') as l, max(split = 'val') as r from l where split in ('train', 'val') group by all)
select key, count(case when l then 1 end) as n_train, count(case when r then 1 end) as n_val, count(case when l and r then 1 end) as n_shared from g group by key""")
def _(spark, sf):
    return D.audit_split(D.split_lygo(FX.meta_trials(spark, sf), 2000, TT), ["parent1", "parent2", "row_key"])
