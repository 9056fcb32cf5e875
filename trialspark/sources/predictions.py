"""Prediction files: one model per file, provenance kept, keys checked before merging."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions import expressions as X
from trialspark.schema import TrialError, require_columns
from trialspark.shared import materialize

# Fixed values that results depend on.
REQUIRED = ["Env", "id", "Actual", "Pred"]
LABEL_ATOL, LABEL_RTOL = 1e-6, 1e-5
LISTED = 32  # paths of one reader that Spark lists without a job of its own


def assign_model_names(df: DataFrame, file: str = "file", name_col: str = "model_name") -> DataFrame:
    """Add ``model``: the file's single distinct non-empty name, else its stem; cleaned, and
    numbered from the second file on when several files share it (in file order)."""
    given = F.col(name_col).cast("string") if name_col in df.columns else F.lit(None).cast("string")
    given = F.when(given != "", given)
    per = df.groupBy(file).agg(F.min(given).alias("lo"), F.max(given).alias("hi"))
    stem = X.file_stem(file)
    base = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(stem)
    base = F.coalesce(F.nullif(X.clean_model_name(base), F.lit("")), stem)
    named = per.select(file, base.alias("base"))
    w = Window.partitionBy("base").orderBy(file)  # one row per file
    numbered = named.withColumn("k", F.row_number().over(w))
    model = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string")))
    return df.join(numbered.select(file, model.alias("model")), file)


def _existing(spark: SparkSession, pattern: str) -> list[str]:
    """Expand one glob with the file system Spark reads from."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(str(s.getPath().toString()) for s in (found or []))


def expand_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """All files behind the patterns; a pattern without a match is an error."""
    out: list[str] = []
    for p in patterns:
        found = _existing(spark, p)
        if not found:
            raise TrialError(f"no file matches {p}")
        out += [f for f in found if f not in out]
    return out


def _plain(path: str) -> str:
    """A path without scheme and escapes, as listings and file metadata write them differently."""
    return re.sub(r"^([a-z][a-z0-9+.-]*:)?/+", "/", unquote(path))


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Data files behind the paths by their first line, from one pass over the first splits."""
    at = F.monotonically_increasing_id().alias("at")
    parts = [spark.read.text(paths[i : i + LISTED]) for i in range(0, len(paths), LISTED)]
    tagged = [p.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at, "value") for p in parts]
    lines = reduce(DataFrame.unionByName, tagged)
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    files: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():  # one row per file, like a listing
        files.setdefault(r["header"], []).append(unquote(r["file"]))
    return files


def read_predictions(spark: SparkSession, patterns: list[str], fmt: str = "csv") -> DataFrame:
    """Long table ``(env, id, actual, pred, model, checkpoint_dir, file)`` over all files.

    Files may order or extend their columns freely: CSV files are grouped by their header line and
    each group is one scan, whatever the number of files. Other formats are opened path by path.
    """
    paths = expand_paths(spark, patterns)
    if fmt != "csv":
        return assign_model_names(reduce(DataFrame.unionByName, [_long(spark.read.format(fmt).load(p), F.lit(p), p) for p in paths]))
    given = {_plain(p): p for p in paths}
    parts = []
    for header, files in _headers(spark, paths).items():
        owner = {}
        for f in files:
            at = _plain(f)
            while at not in given:  # a part file belongs to the folder that was given
                at = at.rpartition("/")[0]
            owner[_plain(f)] = given[at]
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.csv(files, header=True, schema=schema)
        owners = spark.createDataFrame(list(owner.items()), "__file string, file string")  # one row per file
        plain = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^([a-z][a-z0-9+.-]*:)?/+", "/")
        one = len(set(owner.values())) == 1
        tagged = raw if one else raw.withColumn("__file", plain).join(F.broadcast(owners), "__file")
        parts.append(_long(tagged, F.lit(next(iter(owner.values()))) if one else F.col("file"), files[0]))
    if not parts:
        raise TrialError("the prediction files are empty")
    return assign_model_names(reduce(DataFrame.unionByName, parts))


def _long(raw: DataFrame, file: Column, where: str) -> DataFrame:
    require_columns(raw, REQUIRED, where)
    opt = {c: (F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")) for c in ("model_name", "checkpoint_dir")}
    return raw.select(
        F.col("Env").cast("string").alias("env"),
        F.col("id").cast("string").alias("id"),
        F.col("Actual").try_cast("double").alias("actual"),
        F.col("Pred").try_cast("double").alias("pred"),
        opt["model_name"].alias("model_name"),
        opt["checkpoint_dir"].alias("checkpoint_dir"),
        file.alias("file"),
    )


def labels_agree(lo: Column, hi: Column) -> Column:
    """True where the largest and the smallest label of a key differ by no more than the tolerances."""
    return (hi - lo) <= F.lit(LABEL_ATOL) + F.lit(LABEL_RTOL) * F.abs(lo)


def merge_predictions(long: DataFrame, models: list[str] | None = None, check: bool = True, model: str = "model") -> DataFrame:
    """Wide table ``(env, id, actual, <one column per model>)`` over keys every model has.

    One grouped pivot replaces a chain of joins. Repeated keys within a model and labels that
    disagree between models are errors, as is an empty result.
    """
    if models is None:
        models = sorted(r[0] for r in long.select(model).distinct().collect())  # one row per prediction file
    tagged = {m: F.when(F.col(model) == m, F.col("pred")) for m in models}
    # fixed-width order and presence marks keep this a hash aggregation
    place = reduce(lambda c, im: c.when(F.col(model) == im[1], im[0]), enumerate(models), F)
    present = [F.max(F.when(F.col(model) == m, 1).otherwise(0)) for m in models]
    mine = long.filter(F.col(model).isin(models))
    wide = mine.groupBy("env", "id").agg(
        F.min_by("actual", place).alias("actual"),
        reduce(lambda a, b: a + b, present).alias("__models"),
        F.count(F.lit(1)).alias("__rows"),
        F.min("actual").alias("__lo"),
        F.max("actual").alias("__hi"),
        *[F.max(c).alias(m) for m, c in tagged.items()],
    )
    full = wide.filter(F.col("__models") == len(models))
    if check:
        full = materialize(full)  # the checks and the caller both read it
        bad = full.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("__rows") > len(models)).alias("dup"),
            F.count_if(~F.coalesce(labels_agree(F.col("__lo"), F.col("__hi")), F.lit(True))).alias("disagree"),
        ).first()
        if bad["n"] == 0:
            raise TrialError("no (env, id) key is shared by all prediction files")
        if bad["dup"]:
            raise TrialError(f"{bad['dup']} (env, id) keys repeat within a prediction file")
        if bad["disagree"]:
            raise TrialError(f"labels differ between files for {bad['disagree']} keys")
    return full.drop("__models", "__rows", "__lo", "__hi")
