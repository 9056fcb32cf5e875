"""Batch plan queries (B1–B2) and the streaming query."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_META, WITH_PRED, q6, rounded
from trialspark.operators import batches as B
from trialspark.shared import scratch_path
from trialspark.streaming import env_metrics as ST

# env-stratified: chunks of 32 rows, 8 per batch, 3 ranks
B1 = """, n as (select env, count(*) as n from trials group by env), ch as (select env, unnest(range(n // 32)) as chunk from n where n >= 32),
pk as (select env, chunk, row_number() over (order by md5(concat('42/chunk:', env, ':', chunk)), env, chunk) - 1 as pl from ch), bt as (select pl // 8 as batch, count(*)*32 as rows from pk group by 1 {drop}),
tn as (select batch, row_number() over (order by md5(concat('42/batch:', batch)), batch) - 1 as turn, count(*) over () as nb from bt),
sc as (select batch, turn from tn union all select batch, turn + nb from tn where turn < (3 - nb % 3) % 3),
po as (select row_key, env, row_number() over (partition by env order by md5(concat('42/row:', row_key)), row_key) - 1 as p from trials)
select row_key, po.env, turn % 3 as rank, turn // 3 as step, pl % 8 * 32 + p % 32 as slot from po join pk on po.env = pk.env and p // 32 = chunk join sc on sc.batch = pl // 8"""


@query("b1_env_stratified_plan", "B1", WITH_META + B1.format(drop=""))
def _(spark, sf):
    return B.env_stratified_plan(FX.trials(spark, sf), 256, 32, world=3)


@query("b1_plan_drop_last", "B1", WITH_META + f"select rank, step, count(*) as n, cast(min(slot) as bigint) as lo, cast(max(slot) as bigint) as hi, count(distinct env) as n_envs from ({WITH_META + B1.format(drop='having count(*)*32 >= 128')}) group by all".replace("with trials", "with trials", 1))
def _(spark, sf):
    plan = B.env_stratified_plan(FX.trials(spark, sf), 256, 32, world=3, drop_last=True)
    return plan.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("env").alias("n_envs"))


@query("b2_mixed_env_plan", "B2", WITH_META + """, n as (select env, count(*) as n, sum(count(*)) over (order by md5(concat('42/env:', env)), env) as upto from trials group by env), t as (select count(*) as total, cast(floor(count(*)*0.4::double) as bigint) as ne from trials),
tk as (select env, greatest(0, least(n, ne - (upto - n))) as take from n, t),
a as (select row_key, 'env' as source from (select row_key, env, row_number() over (partition by env order by md5(concat('42/row:', row_key)), row_key) as p from trials) join tk using (env) where p <= take),
r as (select row_key, 'random' as source from (select row_key, row_number() over (order by md5(concat('42/random:', row_key)), row_key) as p from trials), t where p <= total - ne),
m as (select *, row_number() over (order by md5(concat('42/mix:', source, ':', row_key)), source, row_key) - 1 as p from (select * from a union all select * from r))
select row_key, source, p % 4 as rank, p // 4 as step from m""")
def _(spark, sf):
    return B.mixed_env_plan(FX.trials(spark, sf), 0.4, world=4)


@query("r1_stream_env_metrics", "R1", WITH_PRED + f""", m as (select env, count(*) as n, regr_sxx(pred, actual) as saa, regr_syy(pred, actual) as spp, regr_sxy(pred, actual) as sap, sum(power(actual-pred,2)) as sse from pred group by env),
v as (select *, case when n >= 2 and saa > 1e-8 and spp > 1e-8 then greatest(-1.0::double, least(1.0::double, sap/(sqrt(saa)*sqrt(spp)))) end as r from m)
select env, n, {q6('r')} as pcc, {q6('sse/n')} as mse from v union all select null, cast(sum(n) as bigint), {q6('avg(r)')}, {q6('sum(sse)/sum(n)')} from v""")
def _(spark, sf):
    """Plots arrive as a file stream and meet the static order tables."""
    schema = FX.table(spark, sf, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    scored = FX.predictions(FX.trials(spark, sf, stream))
    out = scratch_path(spark, "stream-metrics")
    ST.stream_env_metrics(scored, out, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return rounded(ST.latest_metrics(spark, out))
