"""Running per-environment accuracy of a stream of scored rows.

Each trigger publishes a numbered snapshot: its folder is written first, then a pointer file names it,
and snapshots that fall out of the last few are deleted. A reader follows the pointer, so it never
sees a half-written snapshot, and begins anew when the one it reads expires under it.

The state is the additive moment table (one small row per environment). A drained stream holds
the same moments as a batch aggregation of all rows, so the macro score equals the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trialspark.operators.metrics import env_moments, finite_pairs, pcc_from_moments
from trialspark.schema import TrialError

KEEP = 5  # snapshots left, so that readers have that many triggers to finish
SNAPSHOT, POINTER = "snapshot=", "_committed="

def env_state(stream: DataFrame, env: str = "env", actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Streaming moments per environment."""
    return env_moments(finite_pairs(stream, actual, pred), env, actual, pred)


def metrics_from_state(state: DataFrame, env: str = "env") -> DataFrame:
    """Per-environment n, PCC and MSE with the macro PCC in the row whose environment is NULL."""
    per = pcc_from_moments(state).withColumn("mse", F.try_divide("sse", "n"))
    rolled = per.rollup(env).agg(F.sum("n").alias("n"), F.avg("r").alias("pcc"), F.try_divide(F.sum("sse"), F.sum("n")).alias("mse"))
    return rolled


def stream_env_metrics(
    stream: DataFrame, out: str, checkpoint: str, env: str = "env", actual: str = "actual", pred: str = "pred", keep: int = KEEP
) -> StreamingQuery:
    """Start a job that keeps ``out`` at the latest metrics; it ends once the available files are read.

    A repeated batch after a failure writes the same snapshot and pointer again. At most ``keep``
    snapshots are left after each trigger.
    """
    if keep < 2:
        raise TrialError("keep at least two snapshots, for readers of the one before")

    def publish(state: DataFrame, epoch: int) -> None:
        publish_snapshot(metrics_from_state(state, env).withColumn("epoch", F.lit(epoch).cast("long")), out, epoch, keep)

    return (
        env_state(stream, env, actual, pred)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def _files(spark: SparkSession, out: str):
    """The file system of ``out``, the path class and the folder itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(out)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), path, folder


def publish_snapshot(metrics: DataFrame, out: str, epoch: int, keep: int = KEEP) -> None:
    """Write one snapshot, commit it by its pointer, expire all but the last ``keep``."""
    spark = metrics.sparkSession
    fs, path, folder = _files(spark, out)
    metrics.write.mode("overwrite").parquet(f"{out}/{SNAPSHOT}{epoch}")
    # one empty file per committed snapshot: creating it is atomic on every file system
    fs.create(path(f"{out}/{POINTER}{epoch}"), True).close()
    committed = _committed(fs, folder)
    for old in committed[:-keep]:
        fs.delete(path(f"{out}/{POINTER}{old}"), False)  # no reader starts on it any more
        fs.delete(path(f"{out}/{SNAPSHOT}{old}"), True)


def _committed(fs, folder) -> list[int]:
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER))


def latest_metrics(spark: SparkSession, out: str) -> DataFrame:
    """The newest committed snapshot; others are never read."""
    fs, _, folder = _files(spark, out)
    committed = _committed(fs, folder)
    if not committed:
        raise TrialError(f"no snapshot in {out}")
    return spark.read.parquet(f"{out}/{SNAPSHOT}{committed[-1]}").drop("epoch")


def read_latest(spark: SparkSession, out: str, use: Callable[[DataFrame], object], attempts: int = 5) -> object:
    """``use`` of the newest snapshot's rows, begun anew on the then newest when that one expires meanwhile."""
    for left in reversed(range(attempts)):
        before = _committed(*_files(spark, out)[::2])
        try:
            return use(latest_metrics(spark, out))
        except (PySparkException, Py4JJavaError):
            now = _committed(*_files(spark, out)[::2])
            if not left or not before or before[-1] in now:
                raise  # the snapshot is still there, so the failure is another one
