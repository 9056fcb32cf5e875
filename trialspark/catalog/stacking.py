"""Stacking queries (K1–K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_PRED, q6, rounded
from trialspark.catalog.relations import CELL_SQL, cells
from trialspark.functions import expressions as X
from trialspark.operators import stacking as K
from trialspark.shared import materialize

MODELS = ["m_b", "m_c", "m_d"]
N_RANDOM = 2000


def wide(spark, sf, test: bool | None = None):
    c = cells(spark, sf).select("env", "id", "actual", *MODELS)
    if test is None:
        return c
    return c.filter((X.env_year("env") == FX.TEST_YEAR) if test else (X.env_year("env") < FX.TEST_YEAR))


PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
MOMENTS = ", trn as (select * from cell where env not like '%_2001'), mom as (select env, count(*) as n, regr_sxx(actual, actual) as syy, " + ", ".join(
    [f"regr_sxy({m}, actual) as sy_{i}" for i, m in enumerate(MODELS)] + [f"regr_sxy({MODELS[j]}, {MODELS[i]}) as s_{i}_{j}" for i, j in PAIRS]) + " from trn group by env)"
U = "(cast('0x' || substr(md5(concat('42:', c, ':{i}')), 1, 12) as bigint) + 0.5::double)/281474976710656"
CAND = ", ce as (select c, " + ", ".join(f"-ln({U.format(i=i)}) as e{i}" for i in range(3)) + f" from range({1 + 3 + N_RANDOM}) t(c)), cand as (select c, " + ", ".join(
    f"case when c = 0 then 1.0::double/3 when c <= 3 then (c = {i + 1})::int::double else e{i}/(e0+e1+e2) end as w{i}" for i in range(3)) + " from ce)"
VAR = " + ".join(f"{'' if i == j else '2*'}w{i}*w{j}*s_{i}_{j}" for i, j in PAIRS)
COV = " + ".join(f"w{i}*sy_{i}" for i in range(3))
SEARCH = MOMENTS + CAND + f""", sc as (select c, any_value(w0) as w0, any_value(w1) as w1, any_value(w2) as w2, avg(case when ({VAR}) > 1e-8 then greatest(-1.0::double, least(1.0::double, ({COV})/(sqrt({VAR})*sqrt(syy)))) end) as score
 from mom, cand where n >= 2 and syy > 1e-8 group by c), best as (select * from sc order by score desc, c limit 1)"""


@query("k1_stack_moments", "K1", WITH_PRED + CELL_SQL + MOMENTS + " select env, n, " + ", ".join(f"{q6(c, 4)} as {c}" for c in ["syy", "sy_0", "sy_1", "sy_2"] + [f"s_{i}_{j}" for i, j in PAIRS]) + " from mom")
def _(spark, sf):
    return rounded(K.stack_moments(wide(spark, sf, False), MODELS), 4)


@query("k2_search_weights", "K2", WITH_PRED + CELL_SQL + SEARCH + f" select c as cand, {q6('score')} as score, {q6('w0')} as w_0, {q6('w1')} as w_1, {q6('w2')} as w_2 from best")
def _(spark, sf):
    return rounded(K.search_weights(K.stack_moments(wide(spark, sf, False), MODELS), MODELS, N_RANDOM))


ROUNDS, N_AROUND = 4, 128


def _round(r: int) -> str:
    """One refinement round: points around the incumbent of the round before, the best of them next."""
    u = "(cast('0x' || substr(md5(concat('42/{r}:', c, ':{i}')), 1, 12) as bigint) + 0.5::double)/281474976710656"
    e = ", ".join(f"-ln({u.format(r=r, i=i)}) as e{i}" for i in range(3))
    point = [f"case when c = 0 then 1.0::double/3 when c <= 3 then (c = {i + 1})::int::double else e{i}/(e0+e1+e2) end" for i in range(3)]
    step = f"(case when c = 0 then 0.0::double else {0.5 / 2**r}::double end)"
    around = ", ".join(f"b.w{i}*(1 - {step}) + ({point[i]})*{step} as w{i}" for i in range(3))
    return f""", ce{r} as (select c, {e} from range({1 + 3 + N_AROUND}) t(c)), ca{r} as (select c, {around} from ce{r}, b{r} b),
 sc{r} as (select c, any_value(w0) as w0, any_value(w1) as w1, any_value(w2) as w2, avg(case when ({VAR}) > 1e-8 then greatest(-1.0::double, least(1.0::double, ({COV})/(sqrt({VAR})*sqrt(syy)))) end) as score
 from mom, ca{r} where n >= 2 and syy > 1e-8 group by c), b{r + 1} as (select w0, w1, w2, score from sc{r} order by score desc, c limit 1)"""


REFINE = MOMENTS + ", b0 as (select 1.0::double/3 as w0, 1.0::double/3 as w1, 1.0::double/3 as w2, 0.0::double as score)" + "".join(_round(r) for r in range(ROUNDS))


@query("k3_refine_weights", "K3", WITH_PRED + CELL_SQL + REFINE + f" select (select count(*) from mom) as n_envs, {q6('score')} as score, {q6('w0')} as w_0, {q6('w1')} as w_1, {q6('w2')} as w_2 from b{ROUNDS}")
def _(spark, sf):
    moments = materialize(K.stack_moments(wide(spark, sf, False), MODELS))
    best = K.refined(moments, MODELS, [1 / 3] * 3, rounds=ROUNDS, n_random=N_AROUND)
    return rounded(best.join(F.broadcast(moments.agg(F.count(F.lit(1)).alias("n_envs")))))  # one row each


@query("k4_apply_stack", "K4", WITH_PRED + CELL_SQL + SEARCH + f", x as (select env, id, actual, m_b*w0 + m_c*w1 + m_d*w2 as p from cell, best where env like '%_2001') select env, id, {q6('actual', 9)} as actual, {q6('p', 9)} as pred, 'stack' as model_name, 'stack:m_b,m_c,m_d' as checkpoint_dir from x")
def _(spark, sf):
    best = K.search_weights(K.stack_moments(wide(spark, sf, False), MODELS), MODELS, N_RANDOM)
    return rounded(K.apply_stack(wide(spark, sf, True), MODELS, best), 9)


def _report(part: str, cond: str) -> str:
    return f"""select '{part}' as split, (select count(*) from {part}) as n_rows, {q6(f'(select corr(p, actual) from {part})')} as global_pcc, {q6(f'(select avg(power(p-actual,2)) from {part})')} as global_mse,
 {q6(f'(select avg(r) from (select corr(p, actual) as r from {part} group by env having count(*) >= 2))')} as env_pcc, {q6(f'(select avg(e) from (select avg(power(p-actual,2)) as e from {part} group by env))')} as env_mse"""


@query("k5_stack_report", "K5", WITH_PRED + CELL_SQL + """, x as (select env, id, actual, m_b*0.5::double + m_c*0.125::double + m_d*0.375::double as p from cell), train as (select * from x where env not like '%_2001'), test as (select * from x where env like '%_2001') """ + _report("train", "") + " union all " + _report("test", ""))
def _(spark, sf):
    return rounded(K.stack_report(wide(spark, sf, False), wide(spark, sf, True), MODELS, [0.5, 0.125, 0.375]))


@query("k5_weights_report", "K5", WITH_PRED + CELL_SQL + SEARCH + f" select 'm_b' as model, {q6('w0')} as weight from best union all select 'm_c', {q6('w1')} from best union all select 'm_d', {q6('w2')} from best")
def _(spark, sf):
    best = K.search_weights(K.stack_moments(wide(spark, sf, False), MODELS), MODELS, N_RANDOM)
    return rounded(K.stack_weights_report(best, MODELS))
