"""Session helpers: the shared folder, durable materialisation, joins that keep NULL keys."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.schema import TrialError


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a fresh one in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise TrialError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trialspark-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


class _Scopes(threading.local):
    """Open ``scratch`` blocks of a thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; the innermost open ``scratch`` will delete it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block (by this thread) when it ends.

    Results that read such tables have to be written or collected inside the block.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.open.pop():  # blocks end in reverse order, so the last one is this one
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def finished(spark: SparkSession, build: Callable[[], dict[str, DataFrame]], order: dict[str, list] | None = None) -> dict[str, DataFrame]:
    """The tables that ``build()`` gives, each written once; every intermediate made on the way is deleted.

    ``order`` names the sort columns of tables that have an order. The written results belong to the block
    outside, if there is one, else to the caller.
    """
    with scratch(spark):
        tables = build()
        schemas = {name: t.schema for name, t in tables.items()}
        paths = {name: f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in tables}
        for name, t in tables.items():
            t.write.parquet(paths[name])
    if _scopes.open:
        _scopes.open[-1].extend(paths.values())
    read = {name: spark.read.schema(schemas[name]).parquet(paths[name]) for name in paths}
    return read | {name: read[name].orderBy(*columns) for name, columns in (order or {}).items() if name in read}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike an eager checkpoint this computes the input a single time, and the reader keeps column
    pruning and size statistics. Lost executors cost nothing: readers go back to the files.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILES_PER_CORE = 3  # of a table in few files
SHARE = 16  # of the session's shuffle partitions go through one task at most, so that its share doesn't grow with the input


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` in few partitions: ``FILES_PER_CORE`` for each core, more where that would be over ``SHARE`` shuffle partitions each.

    A task takes its share of the former partitions one after the other.
    Where partitions are many and small, writing is mostly the opening of files, and on a store without Hadoop's
    native library each file makes its executor launch processes (``chmod``).
    """
    return df.coalesce(_few(df.sparkSession))


def _few(spark: SparkSession) -> int:
    return max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARE)


def gather(df: DataFrame) -> DataFrame:
    """``materialize`` in few files."""
    return materialize(in_few_files(df))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the right keys are dropped."""
    if not keys:
        return left.join(F.broadcast(right), how=how)  # right is a one-row total
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    joined = left.join(r, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])
