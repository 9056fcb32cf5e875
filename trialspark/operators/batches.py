"""Batch plans: a table that tells every row which rank sees it, when and at which place.

Rows are ordered by seeded digests, so a plan is a few joins on small chunk and batch tables and
is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.expressions import hash_order
from trialspark.operators import ordering as O
from trialspark.schema import TrialError
from trialspark.shared import materialize


def _seed(seed: int, epoch: int, part: str) -> str:
    return f"{seed + epoch}/{part}"


def env_stratified_plan(
    df: DataFrame,
    batch_size: int,
    m: int,
    world: int = 1,
    seed: int = 42,
    epoch: int = 0,
    drop_last: bool = False,
    env: str = "env",
    key: str = "row_key",
    split_rows: int = O.SPLIT_ROWS,
) -> DataFrame:
    """``(key, env, rank, step, slot)``: batches packed from full chunks of ``m`` rows of one environment.

    Rows beyond the last full chunk of an environment are left out of the epoch, as are
    environments with fewer than ``m`` rows. Batches repeat from the start until every rank has
    the same number.
    """
    if batch_size < m:
        raise TrialError("batch_size must be at least the chunk size")
    per_batch = batch_size // m
    rows, total_rows = O.counted(df.select(F.col(key).alias("row_key"), F.col(env).alias("env")))
    rows = rows.withColumn("__h", hash_order(_seed(seed, epoch, "row"), "row_key"))
    sizes = materialize(rows.groupBy("env").agg(F.count(F.lit(1)).alias("n")))
    # chunk order and packing work on the chunk table, which follows from the environment sizes
    chunks = sizes.filter(F.col("n") >= m).select("env", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n div {m} as int) - 1"))).alias("chunk"))
    chunks = chunks.withColumn("__h", hash_order(_seed(seed, epoch, "chunk"), "env", "chunk"))
    packed = O.positions(chunks, [], [F.col("__h"), F.col("env"), F.col("chunk")], "place", split_rows)
    packed = packed.select("env", "chunk", F.expr(f"(place - 1) div {per_batch}").alias("batch"), F.expr(f"(place - 1) % {per_batch}").alias("seat"))
    packed = materialize(packed)
    batches = packed.groupBy("batch").agg((F.count(F.lit(1)) * m).alias("rows"))
    if drop_last:
        batches = batches.filter(F.col("rows") >= batch_size // 2)
    batches = batches.withColumn("__h", hash_order(_seed(seed, epoch, "batch"), "batch"))
    turn = O.positions(batches, [], [F.col("__h"), F.col("batch")], "turn", split_rows).select("batch", (F.col("turn") - 1).alias("turn"))
    total = turn.agg(F.count(F.lit(1)).alias("n_batches"))
    pad = (F.lit(world) - F.col("n_batches") % world) % world
    turns = F.when(F.col("turn") < pad, F.array(F.col("turn"), F.col("turn") + F.col("n_batches"))).otherwise(F.array("turn"))
    schedule = turn.join(F.broadcast(total)).select("batch", F.explode(turns).alias("turn"))  # total is one row
    schedule = schedule.select("batch", (F.col("turn") % world).alias("rank"), F.expr(f"turn div {world}").alias("step"))
    placed = O.positions(rows, ["env"], [F.col("__h"), F.col("row_key")], "pos", split_rows, total_rows)
    placed = placed.select("row_key", "env", F.expr(f"cast((pos - 1) div {m} as int)").alias("chunk"), ((F.col("pos") - 1) % m).alias("offset"))
    plan = placed.join(packed, ["env", "chunk"]).join(schedule, "batch")
    return plan.select("row_key", "env", "rank", "step", (F.col("seat") * m + F.col("offset")).alias("slot"))


def mixed_env_plan(
    df: DataFrame,
    ratio: float = 0.5,
    world: int = 1,
    seed: int = 42,
    epoch: int = 0,
    env: str = "env",
    key: str = "row_key",
    split_rows: int = O.SPLIT_ROWS,
) -> DataFrame:
    """``(key, source, rank, step)``: a share of the epoch from whole shuffled environments in turn
    (the last one cut), the rest random rows without replacement; everything shuffled, then dealt
    to ranks in turn. The random part may repeat rows of the first part."""
    if not 0.0 <= ratio <= 1.0:
        raise TrialError("ratio must lie in [0, 1]")
    rows, total = O.counted(df.select(F.col(key).alias("row_key"), F.col(env).alias("env")))
    turn = hash_order(_seed(seed, epoch, "env"), "env")
    sizes = materialize(rows.groupBy("env").agg(F.count(F.lit(1)).alias("n")).withColumn("__h", turn))
    n_env = int(total * ratio)
    cum = O.running_sums(sizes, [], [F.col("__h"), F.col("env")], {"upto": F.col("n")}, split_rows)
    # environments are whole up to the first that doesn't fit, which is cut; without an environment a row is in neither
    cut = cum.filter(F.col("upto") > n_env).orderBy("upto").first()
    first = rows.filter(F.col("env").isNotNull())
    if cut is not None:
        inside, at = rows.filter(F.col("env") == F.lit(cut["env"])), (turn == F.lit(cut["__h"])) & (F.col("env") < F.lit(cut["env"]))
        first = first.filter((turn < F.lit(cut["__h"])) | at).select("row_key").unionByName(
            O.lowest(inside.select("row_key"), hash_order(_seed(seed, epoch, "row"), "row_key"), [F.col("row_key")], n_env - cut["upto"] + cut["n"], cut["n"], split_rows)
        )
    second = O.lowest(rows.select("row_key"), hash_order(_seed(seed, epoch, "random"), "row_key"), [F.col("row_key")], total - n_env, total, split_rows)
    mixed = first.select("row_key", F.lit("env").alias("source")).unionByName(second.select("row_key", F.lit("random").alias("source")))
    dealt = O.digest_positions(mixed, hash_order(_seed(seed, epoch, "mix"), "source", "row_key"), [F.col("source"), F.col("row_key")], "pos", total, split_rows)
    return dealt.select("row_key", "source", ((F.col("pos") - 1) % world).alias("rank"), F.expr(f"(pos - 1) div {world}").alias("step"))
