"""Prediction stacking: one scan for per-environment moments, then every weight vector is scored
from the moments alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import finite, hash_order, hash_unit
from trialspark.operators.metrics import VAR_EPS, clamp, run_metrics
from trialspark.schema import TrialError
from trialspark.shared import materialize

# Fixed values that results depend on.
N_RANDOM, SEARCH_SEED = 2000, 42
STACK_PREFIX = "stack:"


def stack_moments(wide: DataFrame, models: Sequence[str], env: str = "env", actual: str = "actual") -> DataFrame:
    """Per environment: rows, centred square sum of the target ``syy``, products of each model
    with it ``sy_i`` and of each model pair ``s_i_j`` (i ≤ j)."""
    k = range(len(models))
    ok = reduce(lambda a, b: a & b, [finite(c) for c in (actual, *models)])
    rows = wide.filter(ok)
    return rows.groupBy(env).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx(actual, actual).alias("syy"),
        *[F.regr_sxy(models[i], actual).alias(f"sy_{i}") for i in k],
        *[F.regr_sxy(models[j], models[i]).alias(f"s_{i}_{j}") for i in k for j in k if i <= j],
    )


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def candidate_weights(spark, models: Sequence[str], n_random: int = N_RANDOM, seed: int | str = SEARCH_SEED) -> DataFrame:
    """``(cand, w_0 … w_k-1)``: uniform, each model alone, then seeded points of the simplex.

    A random point is a set of exponentials ``−ln u`` divided by their sum, with u taken from a
    digest of seed, candidate and model index. The row count is fixed by ``n_random``.
    """
    k = len(models)
    if k == 0:
        raise TrialError("no models to stack")
    c = F.col("cand")
    e = [-F.log(hash_unit(hash_order(seed, c, F.lit(i)))) for i in range(k)]
    df = spark.range(1 + k + n_random).select(F.col("id").alias("cand"), *[x.alias(f"e_{i}") for i, x in enumerate(e)])
    total = _sum([F.col(f"e_{i}") for i in range(k)])
    ws = [
        F.when(c == 0, F.lit(1.0 / k)).when(c <= k, (c == i + 1).cast("double")).otherwise(F.col(f"e_{i}") / total)
        for i in range(k)
    ]
    return df.select("cand", *[w.alias(f"w_{i}") for i, w in enumerate(ws)])


def score_candidates(moments: DataFrame, candidates: DataFrame, k: int, n_candidates: int) -> DataFrame:
    """Macro environment Pearson of every candidate: ``(cand, score)``.

    Each environment row lists the candidate numbers and meets their weights by an equi-join, so
    the work is environments × candidates, aggregated before it is shuffled.
    """
    usable = moments.filter((F.col("n") >= 2) & (F.col("syy") > VAR_EPS))
    spread = usable.withColumn("cand", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_candidates - 1).cast("long"))))
    joined = spread.join(F.broadcast(candidates), "cand")  # rows fixed by the search parameter
    w = [F.col(f"w_{i}") for i in range(k)]
    cov = _sum([w[i] * F.col(f"sy_{i}") for i in range(k)])
    var = _sum([w[i] * w[j] * F.col(f"s_{i}_{j}") * (1.0 if i == j else 2.0) for i in range(k) for j in range(i, k)])
    r = F.when(var > VAR_EPS, clamp(cov / (F.sqrt(var) * F.sqrt("syy"))))
    return joined.groupBy("cand").agg(F.avg(r).alias("score"))


def search_weights(
    moments: DataFrame, models: Sequence[str], n_random: int = N_RANDOM, seed: int | str = SEARCH_SEED, candidates: DataFrame | None = None
) -> DataFrame:
    """One row: the best candidate (first on ties), its score and weights ``w_i``."""
    k = len(models)
    n = 1 + k + n_random
    if candidates is None:
        candidates = candidate_weights(moments.sparkSession, models, n_random, seed)
    scores = score_candidates(moments, candidates, k, n)
    low = F.lit(float("-inf"))
    best = scores.agg(F.max_by(F.struct("cand", "score"), F.struct(F.coalesce("score", low), -F.col("cand"))).alias("b")).select("b.*")
    return best.join(F.broadcast(candidates), "cand").select("cand", "score", *[f"w_{i}" for i in range(k)])


def refined(
    moments: DataFrame, models: Sequence[str], weights: Sequence[float], rounds: int = 6, n_random: int = 256, radius: float = 0.5, seed: int | str = SEARCH_SEED
) -> DataFrame:
    """Re-sample the simplex around the incumbent with a shrinking radius and keep what scores best: ``score, w_i``.

    The rounds are one plan over the moment table. Candidate 0 is the incumbent itself, so a round
    never loses ground; without a usable environment the score is NULL and the weights stay.
    """
    k = len(models)
    w = [float(x) for x in weights]
    if len(w) != k or min(w) < 0 or not math.isclose(sum(w), 1.0, abs_tol=1e-9):
        raise TrialError("weights must lie on the simplex")
    spark = moments.sparkSession
    names = [f"w_{i}" for i in range(k)]
    held = spark.range(1).select(F.lit(None).cast("double").alias("score"), *[F.lit(x).alias(n) for x, n in zip(w, names)])
    for r in range(rounds):
        points = candidate_weights(spark, models, n_random, f"{seed}/{r}").toDF("cand", *[f"p_{i}" for i in range(k)])
        step = F.when(F.col("cand") == 0, F.lit(0.0)).otherwise(F.lit(radius / 2**r))
        moved = [(F.col(n) * (F.lit(1.0) - step) + F.col(f"p_{i}") * step).alias(n) for i, n in enumerate(names)]
        around = materialize(points.join(F.broadcast(held.select(*names))).select("cand", *moved))  # held is one row
        best = search_weights(moments, models, n_random, seed, around).select("score", *names)
        both = held.select(F.lit(1).alias("__o"), "score", *names).unionByName(best.select(F.lit(0).alias("__o"), "score", *names))
        top = F.max_by(F.struct("score", *names), F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("__o")))
        held = materialize(both.filter("score is not null or __o = 1").agg(top.alias("b")).select("b.*"))
    return held


def refine_weights(
    moments: DataFrame, models: Sequence[str], weights: Sequence[float], rounds: int = 6, n_random: int = 256, radius: float = 0.5, seed: int | str = SEARCH_SEED
) -> tuple[list[float], float]:
    """``refined`` as numbers: the weights and their score (minus infinity if nothing could be scored)."""
    top = refined(moments, models, weights, rounds, n_random, radius, seed).first()
    return [top[f"w_{i}"] for i in range(len(models))], -math.inf if top["score"] is None else top["score"]


def apply_stack(wide: DataFrame, models: Sequence[str], weights: Sequence[float] | DataFrame, name: str = "stack") -> DataFrame:
    """Weighted prediction with model name and provenance; weights come as numbers or as the
    one-row result of the search."""
    if isinstance(weights, DataFrame):
        cols = [f"w_{i}" for i in range(len(models))]
        wide = wide.join(F.broadcast(weights.select(*cols)))  # one row
        w = [F.col(c) for c in cols]
    else:
        if len(weights) != len(models):
            raise TrialError(f"{len(weights)} weights for {len(models)} models")
        w = [F.lit(float(x)) for x in weights]
    pred = _sum([F.col(m) * w[i] for i, m in enumerate(models)])
    return wide.select(
        "env", "id", "actual", pred.alias("pred"), F.lit(name).alias("model_name"), F.lit(STACK_PREFIX + ",".join(models)).alias("checkpoint_dir")
    )


def stack_weights_report(weights: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(model, weight)``, largest first."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"w_{i}").alias("weight")) for i, m in enumerate(models)]))
    return weights.select(rows.alias("r")).select("r.*").orderBy(F.desc("weight"), "model")


def stack_report(
    train: DataFrame, test: DataFrame | None, models: Sequence[str], weights: Sequence[float] | DataFrame, test_models: Sequence[str] | None = None
) -> DataFrame:
    """Rows, global PCC and MSE, environment PCC and MSE of the stack on train and test."""
    if test is not None and list(test_models or models) != list(models):
        raise TrialError("test predictions must list the same models in the same order")
    out = []
    for part, df in (("train", train), ("test", test)):
        if df is None:
            continue
        s = apply_stack(df, models, weights)
        m = run_metrics(s, rank_pred="pred", key="id")
        out.append(m.select(F.lit(part).alias("split"), F.col("n").alias("n_rows"), "global_pcc", "global_mse", "env_pcc", "env_mse"))
    return reduce(DataFrame.unionByName, out)
