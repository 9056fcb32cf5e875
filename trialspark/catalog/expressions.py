"""Row-level expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import fixtures as FX
from trialspark.catalog import query
from trialspark.catalog.common import WITH_MARKERS, WITH_META, WITH_PRED, pred, q6, rounded
from trialspark.functions import expressions as X
from trialspark.operators import features as T
from trialspark.sources import predictions as SP


@query("p1_env_year", "P1", WITH_META + "select row_key, cast(right(trim('  ' || env || ' '), 4) as integer) as year from trials")
def _(spark, sf):
    return FX.trials(spark, sf).select("row_key", X.env_year(F.concat(F.lit("  "), "env", F.lit(" "))).alias("year"))


@query("p2_env_year_lenient", "P2", """select event_id, cast(nullif(regexp_extract(concat(event_type, '-', props, '-', cast(2023000 + event_id as varchar)), '(20\\d{2})', 1), '') as integer) as year from events""")
def _(spark, sf):
    e = FX.table(spark, sf, "events")
    text = F.concat("event_type", F.lit("-"), "props", F.lit("-"), (F.lit(2023000) + F.col("event_id")).cast("string"))
    return e.select("event_id", X.env_year_lenient(text).alias("year"))


@query("p3_env_location", "P3", WITH_META + "select row_key, left(env, length(env) - 5) as location from trials")
def _(spark, sf):
    return FX.trials(spark, sf).select("row_key", X.env_location("env").alias("location"))


@query("p4_hybrid_name", "P4", WITH_META + """select row_key, case when site = 0 then env || '_' || hybrid when site = 1 then hybrid || '-x' else hybrid end as hybrid
from trials""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    # site 0 has no dash at all, site 1 has a second dash inside the hybrid
    ident = F.when(F.col("site") == 0, F.concat("env", F.lit("_"), "hybrid")).when(F.col("site") == 1, F.concat("id", F.lit("-x"))).otherwise(F.col("id"))
    return t.select("row_key", X.hybrid_name(ident).alias("hybrid"))


@query("p5_split_parents", "P5", WITH_META + """select row_key, case when site = 0 then split_part(hybrid, '/', 1) when site = 1 then split_part(hybrid, '/', 1) else split_part(hybrid, '/', 1) end as parent1,
case when site = 0 then '' when site = 1 then split_part(hybrid, '/', 2) || '/C' else split_part(hybrid, '/', 2) end as parent2 from trials""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    name = (
        F.when(F.col("site") == 0, F.split_part("hybrid", F.lit("/"), F.lit(1)))
        .when(F.col("site") == 1, F.concat("hybrid", F.lit("/C")))
        .otherwise(F.concat(F.lit(" "), F.replace("hybrid", F.lit("/"), F.lit(" / ")), F.lit(" ")))
    )
    return X.split_parents(t.withColumn("hybrid", name)).select("row_key", "parent1", "parent2")


@query("p6_ensure_meta", "P6", WITH_META + "select row_key, 7 as year, location, hybrid, parent1, parent2 from meta")
def _(spark, sf):
    # an existing year column is kept as it is
    t = FX.trials(spark, sf).drop("hybrid").withColumn("year", F.lit(7))
    return X.ensure_meta(t).select("row_key", "year", "location", "hybrid", "parent1", "parent2")


RAW_CAT = {
    0: None, 1: "", 2: "nan", 3: "NaN", 4: "None", 5: "  ", 6: " UNK "}  # spellings of missing values


@query("p7_normalize_cat", "P7", WITH_META + """select row_key, case when site <= 6 then 'UNK' else c_mktsegment end as segment from trials""")
def _(spark, sf):
    t = FX.trials(spark, sf)
    raw = F.concat(F.lit(" "), "c_mktsegment", F.lit("  "))
    for site, text in RAW_CAT.items():
        raw = F.when(F.col("site") == site, F.lit(text)).otherwise(raw)
    return t.select("row_key", X.normalize_cat(raw).alias("segment"))


@query("p8_coerce_numeric", "P8", """select event_id, coalesce(case when event_type in ('click', 'view') then value end, 0)::double as filled,
case when event_type in ('click', 'view') then value end as kept from events""")
def _(spark, sf):
    e = FX.table(spark, sf, "events")
    text = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit(" "), F.col("value").cast("string"))).when(
        F.col("event_type") == "error", F.lit("nan")
    ).otherwise(F.col("event_type"))
    e = e.withColumns({"filled": text, "kept": text})
    e = X.coerce_numeric(e, ["filled"])
    return X.coerce_numeric(e, ["kept"], None).select("event_id", "filled", "kept")


LONG_MARKERS = ", l as (select vec_id, unnest(markers) as x, unnest(range(len(markers))) as marker from markers)"


@query("p9_dosage_tokens", "P9", WITH_MARKERS + LONG_MARKERS + " select vec_id, cast(marker as integer) as marker, 2*x as dosage, cast(round_even(2*x, 0) as integer) as token from l")
def _(spark, sf):
    m = FX.markers(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(X.dosage("markers").alias("dosage"), X.tokens("markers").alias("token"))).alias("marker", "z"))
    return m.select("vec_id", "marker", "z.dosage", "z.token")


@query("p9_tokens_of_reals", "P9", """with l as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings)
select vec_id, cast(i as integer) as marker, cast(round_even(2*round(x::double*8), 0) as integer) as whole, cast(round_even(round(x::double*64)/2, 0) as integer) as token from l""")
def _(spark, sf):
    """Halves such as 0.5 and 2.5 exercise half-even rounding."""
    e = FX.table(spark, sf, "embeddings")
    whole = X.tokens(F.transform("embedding", lambda x: F.round(x.cast("double") * 8)))
    halves = X.tokens(F.transform("embedding", lambda x: F.round(x.cast("double") * 64) / 4))
    z = e.select("vec_id", F.posexplode(F.arrays_zip(whole.alias("whole"), halves.alias("token"))).alias("marker", "z"))
    return z.select("vec_id", "marker", "z.whole", "z.token")


@query("p10_additive_dominance", "P10", WITH_MARKERS + LONG_MARKERS + " select vec_id, cast(marker as integer) as marker, 2*x-1 as additive, 1-abs(2*x-1) as dominance from l")
def _(spark, sf):
    d = FX.markers(spark, sf).withColumn("d", X.dosage("markers"))
    z = d.select("vec_id", F.posexplode(F.arrays_zip(X.additive("d").alias("additive"), X.dominance("d").alias("dominance"))).alias("marker", "z"))
    return z.select("vec_id", "marker", "z.additive", "z.dominance")


@query("p11_marker_onehot", "P11", WITH_MARKERS + LONG_MARKERS + """ select cast(marker as integer) as marker, cast(sum(case when x = 0 then 1 else 0 end) as bigint) as n0,
cast(sum(case when x = 0.5::double then 1 else 0 end) as bigint) as n1, cast(sum(case when x = 1 then 1 else 0 end) as bigint) as n2 from l group by marker""")
def _(spark, sf):
    m = FX.markers(spark, sf).select(F.posexplode(X.marker_onehot(X.tokens("markers"))).alias("marker", "hot"))
    return m.groupBy("marker").agg(*[F.sum(F.col("hot")[k]).alias(f"n{k}") for k in range(3)])


@query("p12_tester_label", "P12", WITH_META + "select row_key, case when site in (0, 1, 2) then 'UNK' else parent2 end as tester from meta")
def _(spark, sf):
    t = FX.meta_trials(spark, sf)
    raw = F.when(F.col("site") == 0, F.lit(None)).when(F.col("site") == 1, F.lit("")).when(F.col("site") == 2, F.lit(" ")).otherwise(F.col("parent2"))
    return t.select("row_key", X.tester_label(raw).alias("tester"))


@query("p13_scale_label", "P13", WITH_META + f""", s as (select avg(yield_mg) as m, stddev_pop(yield_mg) as sd from trials where env in (select env from trials))
select row_key, {q6('(yield_mg-m)/(sd+1e-8::double)')} as scaled, {q6('(yield_mg-m)/(sd+1e-8::double)*(sd+1e-8::double)+m')} as restored from trials, s""")
def _(spark, sf):
    t = FX.trials(spark, sf).withColumns({"ymean": F.lit(0.0), "resid": F.col("yield_mg")})
    one = T.fit_label_scalers(t).filter("label = 'total'").select("mean", "std")
    s = t.join(F.broadcast(one)).withColumn("scaled", X.scale_label("yield_mg", "mean", "std"))  # one row of parameters
    return rounded(s.select("row_key", "scaled", X.unscale_label("scaled", "mean", "std").alias("restored")))


@query("p14_model_names", "P14", """with f as (select distinct event_type, user_id % 5 as shard from events),
n as (select concat('runs/', event_type, ' run/pred', cast(shard as varchar), '.csv') as file,
 case when shard = 0 then concat('_', event_type, '_v1_') when shard = 1 then concat(event_type, '_v1') when shard = 2 then concat(event_type, '_v1') else concat('pred', cast(shard as varchar)) end as base from f),
c as (select file, trim(base, '_') as base from n),
r as (select *, row_number() over (partition by base order by file) as k from c)
select file, case when k = 1 then base else concat(base, '_', cast(k as varchar)) end as model from r""")
def _(spark, sf):
    e = FX.table(spark, sf, "events").withColumn("shard", F.col("user_id") % 5)
    name = F.when(F.col("shard") == 0, F.concat(F.lit("!"), "event_type", F.lit(" / v1 "))).when(F.col("shard") == 1, F.concat("event_type", F.lit("  v1"))).when(F.col("shard") == 2, F.concat("event_type", F.lit("?v1")))
    # shard 3 names two models in one file, shard 4 none: both fall back to the file stem
    name = F.when(F.col("shard") == 3, F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string"))).otherwise(name)
    e = e.withColumns({"file": F.concat(F.lit("runs/"), "event_type", F.lit(" run/pred"), F.col("shard").cast("string"), F.lit(".csv")), "model_name": name})
    return SP.assign_model_names(e, "file").select("file", "model").distinct()


@query("p15_split_suffix", "P15", """select event_id, event_type as base, case when user_id % 2 = 0 then concat('u', cast(user_id as varchar), '__x') else '' end as suffix from events""")
def _(spark, sf):
    e = FX.table(spark, sf, "events")
    name = F.when(F.col("user_id") % 2 == 0, F.concat("event_type", F.lit("__u"), F.col("user_id").cast("string"), F.lit("__x"))).otherwise(F.col("event_type"))
    base, suffix = X.split_runtime_suffix(name)
    return e.select("event_id", base.alias("base"), suffix.alias("suffix"))


@query("p16_env_affine", "P16", WITH_PRED + f""", pr as (select env, avg(l_discount)*10-1 as a, avg(l_quantity) as b from pred group by env)
select row_key, {q6('(ln(1+exp(a))+0.0001::double)*rank_pred+b')} as total_pred from pred join pr using (env)""")
def _(spark, sf):
    df = pred(spark, sf)
    params = df.groupBy("env").agg((F.avg("l_discount") * 10 - 1).alias("a_env"), F.avg("l_quantity").alias("b_env"))
    return rounded(X.apply_env_affine(df, params).select("row_key", "total_pred"))


@query("p17_recompose_total", "P17", WITH_PRED + f""", e as (select env, avg(m_a) as ym from pred group by env)
select {q6('avg(power(ym+m_d-actual,2))')} as mse_total, {q6('avg(power(ym-m_a,2))')} as mse_mean, {q6('avg(power(m_d-actual,2))')} as mse_resid from pred join e using (env)""")
def _(spark, sf):
    from trialspark.operators import effects as E
    from trialspark.operators import metrics as M

    df = E.env_residuals(pred(spark, sf), "m_a", mean="ymean_pred", resid="r0").withColumn("resid_pred", F.col("m_d"))
    out = M.residual_part_metrics(
        X.recompose_total(df), {"total": ("actual", "total_pred"), "mean": ("m_a", "ymean_pred"), "resid": ("actual", "resid_pred")}
    )
    return rounded(out)
