"""Trial-shaped views over the star-schema tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions import expressions as X

TEST_YEAR = 2001
TEST_TESTERS = ["T1", "T2"]
MODELS = ["m_a", "m_b", "m_c", "m_d"]


# Column types of the shared tables, so that opening one needs no footer job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has slots.

    A table of one row group is one task and everything fused with the scan would run on one
    core. Tables with enough splits, as any large one has, are returned unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(slots, key) if splits < slots else df


def trials(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One row per plot: key, id, environment, hybrid, yield and three covariates."""
    li = balanced(table(spark, sf_dir, "lineitem"), "l_orderkey") if lineitem is None else lineitem
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"), "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # orders meet their customers first, as they are fewer than plots: these are shuffled once, by their order
    places = o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    joined = li.join(places, F.col("l_orderkey") == F.col("o_orderkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    env = F.concat("n_name", F.lit("_"), F.col("o_year"))
    parent = F.concat(F.lit("P"), F.lpad((F.col("l_partkey") % 120 + 20 * (F.col("o_year") - 1995)).cast("string"), 3, "0"))
    hybrid = F.concat(parent, F.lit("/T"), (F.col("l_suppkey") % 4).cast("string"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.concat(env, F.lit("-"), hybrid).alias("id"),
        env.alias("env"),
        hybrid.alias("hybrid"),
        (F.col("l_extendedprice") / 1000).alias("yield_mg"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "c_mktsegment",
        "o_orderpriority",
        (F.col("c_custkey") % 10).alias("site"),
    )


def meta_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trials`` with year, location and parents derived from the names."""
    return X.ensure_meta(trials(spark, sf_dir))


def predictions(df: DataFrame) -> DataFrame:
    """Trials plus four deterministic model columns, ``actual`` and a calibrated pair."""
    y, q, d, t = (F.col(c) for c in ("yield_mg", "l_quantity", "l_discount", "l_tax"))
    m_a = y * 0.7 + q * 0.3
    return df.withColumns(
        {
            "actual": y,
            "m_a": m_a,
            "m_b": y * (1 - d * 5) + q * 0.5,
            "m_c": q + t * 200,
            "m_d": y * 0.2 + t * 100,
            "rank_pred": m_a,
            "pred": m_a * 1.5 + 4,
        }
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id`` with an array of marker values 0 / 0.5 / 1 derived from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    value = F.transform(
        "embedding",
        lambda x: F.when(x.cast("double") < -0.05, 0.0).when(x.cast("double") <= 0.05, 0.5).otherwise(1.0),
    )
    return e.select("vec_id", value.alias("markers"), "embedding")


SQL_TRIALS = """trials as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_key,
         concat(n_name, '_', year(o_orderdate), '-', 'P',
                lpad(cast(l_partkey % 120 + 20*(year(o_orderdate)-1995) as varchar), 3, '0'),
                '/T', cast(l_suppkey % 4 as varchar)) as id,
         concat(n_name, '_', year(o_orderdate)) as env,
         concat('P', lpad(cast(l_partkey % 120 + 20*(year(o_orderdate)-1995) as varchar), 3, '0'),
                '/T', cast(l_suppkey % 4 as varchar)) as hybrid,
         l_extendedprice / 1000 as yield_mg, l_quantity, l_discount, l_tax,
         c_mktsegment, o_orderpriority, c_custkey % 10 as site
  from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey)"""

SQL_META = SQL_TRIALS + """,
meta as (
  select *, cast(regexp_extract(trim(env), '(\\d{4})$', 1) as integer) as year,
         regexp_replace(env, '_\\d{4}$', '') as location,
         trim(split_part(hybrid, '/', 1)) as parent1, trim(split_part(hybrid, '/', 2)) as parent2
  from trials)"""

SQL_PRED = SQL_META + """,
pred as (
  select *, yield_mg as actual, yield_mg*0.7::double + l_quantity*0.3::double as m_a,
         yield_mg*(1 - l_discount*5) + l_quantity*0.5::double as m_b,
         l_quantity + l_tax*200 as m_c, yield_mg*0.2::double + l_tax*100 as m_d,
         yield_mg*0.7::double + l_quantity*0.3::double as rank_pred,
         (yield_mg*0.7::double + l_quantity*0.3::double)*1.5::double + 4 as pred
  from meta)"""

SQL_MARKERS = """markers as (
  select vec_id, embedding,
         list_transform(embedding, lambda x: case when x::double < -0.05::double then 0.0::double
           when x::double <= 0.05::double then 0.5::double else 1.0::double end) as markers
  from embeddings)"""
