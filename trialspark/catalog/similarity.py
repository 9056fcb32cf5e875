"""Similarity queries (X1–X5) over batches that cover all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_MARKERS, q6, rounded
from trialspark.functions import expressions as X
from trialspark.operators import similarity as S

SIZE = 40


def vectors(spark, sf):
    m = FX.markers(spark, sf).select("vec_id", X.dosage("markers").alias("dosage"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return S.batched(m, "vec_id", SIZE)


VEC = WITH_MARKERS.rstrip() + f""", b as (select vec_id, (row_number() over (order by md5(concat('42:', vec_id)), vec_id) - 1)//{SIZE} as batch, list_transform(markers, lambda x: 2*x) as d, list_transform(embedding, lambda x: x::double) as e from markers)"""
LONG = """, l as (select batch, vec_id, unnest(d) as d, unnest(range(len(d))) as k from b), fr as (select batch, k, avg(d)/2 as p from l group by all),
mv as (select batch, greatest(1, count(case when p > 1e-6 and p < 1 - 1e-6::double then 1 end)) as m from fr group by batch),
z as (select batch, vec_id, list(case when p > 1e-6 and p < 1 - 1e-6::double then (d - 2*p)/sqrt(2*p*(1-p) + 1e-6::double) else 0 end order by k) as z, any_value(m) as m from l join fr using (batch, k) join mv using (batch) group by all)"""
IBS = "1 - list_sum(list_transform(list_zip(x.d, y.d), lambda q: abs(q[1]-q[2])))/2/len(x.d)"
COS = "list_inner_product(x.e, y.e)/(sqrt(list_inner_product(x.e, x.e))*sqrt(list_inner_product(y.e, y.e)))"
UPPER = "x.batch = y.batch and x.vec_id <= y.vec_id"


@query("x1_ibs", "X1", VEC + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6(IBS)} as sim from b x join b y on {UPPER}")
def _(spark, sf):
    return rounded(S.ibs(vectors(spark, sf)))


@query("x2_grm", "X2", VEC + LONG + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6('list_inner_product(x.z, y.z)/x.m')} as sim from z x join z y on {UPPER}")
def _(spark, sf):
    return rounded(S.grm(vectors(spark, sf), block=16))


@query("x3_env_cosine", "X3", VEC + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6(COS)} as sim from b x join b y on {UPPER}")
def _(spark, sf):
    return rounded(S.env_similarity(vectors(spark, sf), "cosine", "vec_id", "embedding"))


@query("x3_env_correlation", "X3", VEC.replace("list_transform(embedding, lambda x: x::double) as e", "list_transform(embedding, lambda x: x::double - list_avg(list_transform(embedding, lambda y: y::double))) as e") + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6(COS)} as sim from b x join b y on {UPPER}")
def _(spark, sf):
    return rounded(S.env_similarity(vectors(spark, sf), "correlation", "vec_id", "embedding"))


NEAREST = " select batch, i, j, {q} as sim, place from (select *, row_number() over (partition by batch, i order by round(sim, 9) desc, j) as place from ({pairs})) where place <= 5"


@query("x1_ibs_nearest", "X1", VEC + NEAREST.format(q=q6("sim"), pairs=f"select x.batch, x.vec_id as i, y.vec_id as j, {IBS} as sim from b x join b y on x.batch = y.batch and x.vec_id <> y.vec_id"))
def _(spark, sf):
    return rounded(S.nearest(vectors(spark, sf), "ibs", 5, block=16))


@query("x2_grm_nearest", "X2", VEC + LONG + NEAREST.format(q=q6("sim"), pairs="select x.batch, x.vec_id as i, y.vec_id as j, list_inner_product(x.z, y.z)/x.m as sim from z x join z y on x.batch = y.batch and x.vec_id <> y.vec_id"))
def _(spark, sf):
    return rounded(S.nearest(vectors(spark, sf), "grm", 5))


@query("x3_env_cosine_above", "X3", VEC + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6(COS)} as sim from b x join b y on x.batch = y.batch and x.vec_id < y.vec_id where round({COS}, 9) >= 0.2")
def _(spark, sf):
    return rounded(S.similar_above(vectors(spark, sf), "cosine", 0.2, "vec_id", "embedding", block=16))


PAIR = VEC + LONG + f""", bz as (select b.*, z, m from b join z using (batch, vec_id)),
s as (select x.batch, x.vec_id as i, y.vec_id as j, {COS} as e, {{t}} as t from bz x join bz y on x.batch = y.batch), n as (select batch, count(*) as n from b group by batch)"""
GRM = "list_inner_product(x.z, y.z)/x.m"


@query("x4_alignment_grm_mse", "X4", PAIR.format(t=GRM) + f""", dg as (select batch, greatest(avg(t), 0.1::double) as dd from s where i = j group by batch)
select batch, any_value(n) as n, {q6('avg(power(e - greatest(-1, least(2, t/dd)), 2))')} as loss from s join dg using (batch) join n using (batch) where i <> j group by batch""")
def _(spark, sf):
    return rounded(S.alignment_score(vectors(spark, sf), "grm", "mse"))


@query("x4_alignment_ibs_mse", "X4", PAIR.format(t=IBS) + f" select batch, any_value(n) as n, {q6('avg(power(e - (2*t-1), 2))')} as loss from s join n using (batch) where i <> j group by batch")
def _(spark, sf):
    return rounded(S.alignment_score(vectors(spark, sf), "ibs", "mse"))


@query("x4_alignment_grm_cosine", "X4", PAIR.format(t=GRM) + f" select batch, any_value(n) as n, {q6('1 - sum(e*t)/(sqrt(sum(e*e))*sqrt(sum(t*t)))')} as loss from s join n using (batch) group by batch")
def _(spark, sf):
    return rounded(S.alignment_score(vectors(spark, sf), "grm", "cosine"))


@query("x4_alignment_ibs_kl", "X4", PAIR.format(t=IBS) + f""", q as (select batch, i, ln(sum(exp(e/0.1::double))) - sum(exp(t/0.1::double)*e/0.1::double)/sum(exp(t/0.1::double)) as c from s group by all)
select batch, count(*) as n, {q6('avg(c)')} as loss from q group by batch""")
def _(spark, sf):
    return rounded(S.alignment_score(vectors(spark, sf), "ibs", "kl"))


@query("x4_alignment_env_mse", "X4", VEC + f""", w as (select batch, vec_id, e, list_transform(d, lambda v: v::double) as d from b), s as (select x.batch, x.vec_id as i, y.vec_id as j, {COS} as e, list_inner_product(x.d, y.d)/(sqrt(list_inner_product(x.d, x.d))*sqrt(list_inner_product(y.d, y.d))) as t from w x join w y on x.batch = y.batch)
select batch, count(distinct i) as n, {q6('avg(case when i <> j then power(e - greatest(-1, least(1, t)), 2) end)')} as loss from s group by batch""")
def _(spark, sf):
    return rounded(S.alignment_score(vectors(spark, sf), "cosine", "mse"))


@query("x5_gram", "X5", VEC + f" select x.batch, x.vec_id as i, y.vec_id as j, {q6('list_inner_product(x.e, y.e)')} as dot, {q6('list_inner_product(x.e, x.e)')} as ii, {q6('list_inner_product(y.e, y.e)')} as jj from b x join b y on {UPPER}")
def _(spark, sf):
    g = S.gram(vectors(spark, sf), "vec_id", "embedding", block=16)
    return rounded(g.toDF("batch", "i", "j", "dot", "ii", "jj"))
