"""Run logs, epoch logs and exported run summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.expressions import file_stem, finite
from trialspark.shared import in_few_files, materialize

# Fixed values that results depend on: patterns and keys of the log formats.
TAG_IN_PATH = r"-(baseline|tiny|huge_drop|no_moe|zero_drop|drop[\d.]+)-"
DROPOUT_ENV = r"DROPOUT=([\d.]+)"
DROPOUT_TEXT = r"dropout.*?=\s*([\d.]+)"
CV_PCC = "cv/mean_val_env_avg_pearson"
CV_LOSS = "cv/mean_val_loss"
TEST_LINE = r"\[TEST\]\s+(\S+):\s+env_avg_pearson=([\d.]+).*?mse=([\d.]+)"
SWEEP_NAME = r"sweep\+(\S+)"
FOLD_YEARS = list(range(2015, 2024))
FINISHED = "finished"
SUMMARY_KEYS = {
    "cv_val_pcc": "cv/mean_val_env_avg_pearson",
    "cv_val_std": "cv/std_val_env_avg_pearson",
    "cv_val_loss": "cv/mean_val_loss",
    "test_pcc": "test/env_avg_pearson",
    "test_mse": "test/mse",
    "test_pcc_weighted": "test/env_avg_pearson_weighted",
}
FOLD_KEY = "rolling/test/fold_{}/env_avg_pearson"


NUMBER = r"(\d[\d.]*)"


def read_log_lines(spark: SparkSession, globs: list[str]) -> DataFrame:
    """``log_file, at, value`` per line; ``at`` orders the lines of a file.

    Files of any size are read in splits: a line's place is the offset of its split and its number there.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(globs).select(F.col("_metadata.file_path").alias("log_file"), at.alias("at"), "value")


def _test_lines(lines: DataFrame) -> DataFrame:
    """One row per test result: file, order in the file, tag, PCC and MSE."""
    groups = [F.regexp_extract_all("value", F.lit(TEST_LINE), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("t", "p", "m"))])
    found = lines.filter(F.col("value").contains("[TEST]")).select("log_file", "at", F.posexplode(zipped).alias("no", "z"))
    place = F.struct("at.offset", "at.line", "no").alias("pos")
    return found.select("log_file", place, F.col("z.t").alias("eval_tag"), F.col("z.p").try_cast("double").alias("pcc"), F.col("z.m").try_cast("double").alias("mse"))


def _first_match(pattern: str) -> Column:
    """What the pattern captures on the first line of a file that it matches."""
    got = F.regexp_extract("value", pattern, 1)
    return F.min_by(F.when(got != "", got), F.when(got != "", F.col("at"))).try_cast("double")


def _first_after(lines: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``log_file, number``: the first number behind the first ``key`` of a file, on the same line or a later one.

    ``told`` has all lines with the key; only files whose number isn't beside its key are looked through again.
    """
    beside = F.regexp_extract("value", re.escape(key) + r"[^\d]*" + NUMBER, 1)
    keyed = told.filter(F.col("value").contains(key)).groupBy("log_file").agg(F.min(F.struct("at", F.nullif(beside, F.lit("")).alias("number"))).alias("k"))
    keyed = materialize(keyed.select("log_file", "k.at", "k.number"))
    late = keyed.filter("number is null").select("log_file", F.col("at").alias("key_at"))
    if late.isEmpty():
        return keyed.select("log_file", "number")
    number = F.regexp_extract("value", NUMBER, 1)
    later = lines.join(late, "log_file").filter((F.col("at") > F.col("key_at")) & (number != "")).groupBy("log_file").agg(F.min_by(number, "at").alias("later"))
    return keyed.join(later, "log_file", "left").select("log_file", F.coalesce("number", "later").alias("number"))


def parse_run_logs(spark: SparkSession, globs: list[str]) -> DataFrame:
    """One row per log with test metrics: tag, dropout, CV summary, and the test result of
    ``best_fold`` (its last line) or else of the first test line.

    Test results and dropout settings stand on one line each; the number of a CV summary may follow later.
    Files are opened once: the lines that tell something are written, many small files to a task.
    """
    lines = in_few_files(read_log_lines(spark, globs))
    dropout = F.lower("value").contains("dropout")
    told = materialize(lines.filter(reduce(lambda a, b: a | b, [F.col("value").contains(k) for k in ("[TEST]", CV_PCC, CV_LOSS)], dropout)))
    tests = _test_lines(told)
    best = F.col("eval_tag") == "best_fold"
    result = F.struct("pcc", "mse")
    pick = tests.groupBy("log_file").agg(F.max_by(result, F.when(best, F.col("pos"))).alias("b"), F.min_by(result, "pos").alias("f"))
    pick = pick.select("log_file", F.coalesce("b", "f").alias("t"))
    settings = told.filter(dropout).groupBy("log_file").agg(F.coalesce(_first_match(DROPOUT_ENV), _first_match(DROPOUT_TEXT)).alias("dropout"))
    tag = F.coalesce(F.nullif(F.regexp_extract("log_file", TAG_IN_PATH, 1), F.lit("")), file_stem("log_file"))
    out = pick.join(settings, "log_file", "left")
    for name, key in (("cv_val_pcc", CV_PCC), ("cv_val_loss", CV_LOSS)):
        out = out.join(_first_after(lines, told, key).select("log_file", F.col("number").try_cast("double").alias(name)), "log_file", "left")
    return out.select("log_file", tag.alias("tag"), "dropout", "cv_val_pcc", "cv_val_loss", F.col("t.pcc").alias("test_pcc"), F.col("t.mse").alias("test_mse"))


def parse_fold_scores(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Test PCC per log and fold tag ``fold_<year>`` (the last line of a tag counts)."""
    lines = _test_lines(in_few_files(read_log_lines(spark, globs))).filter(F.col("eval_tag").contains("fold_"))
    fold = F.replace("eval_tag", F.lit("fold_"), F.lit(""))
    return lines.groupBy("log_file", fold.alias("fold")).agg(F.max_by("pcc", "pos").alias("test_pcc"))


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, train_loss, val_loss`` as doubles."""
    return spark.read.csv(path, header=True, schema="epoch double, train_loss double, val_loss double")


def best_epoch(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Epoch of the lowest finite validation loss, the earliest on ties."""
    usable = log.filter(finite("val_loss"))
    return usable.groupBy(*(by or [])).agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best_val_loss"), F.count(F.lit(1)).alias("n_epochs")
    )


RUN_SCHEMA = "id string, name string, state string, `group` string, created_at timestamp, config map<string,string>, summary map<string,double>"


def read_run_exports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def normalize_runs(runs: DataFrame, group: str | None = None) -> DataFrame:
    """Finished runs (of one group) with the metrics under short names.

    The tag is the configured one, else the part after ``sweep+`` in the name, else name or id.
    """
    kept = runs.filter(F.col("state") == FINISHED)
    if group is not None:
        kept = kept.filter(F.col("group") == group)
    name = F.nullif(F.col("name"), F.lit(""))
    tag = F.coalesce(
        F.nullif(F.col("config")["sweep_tag"], F.lit("")), F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), SWEEP_NAME, 1), F.lit("")), name, F.col("id")
    )
    return kept.select(
        F.col("id").alias("run_id"),
        F.col("name").alias("run_name"),
        tag.alias("tag"),
        F.coalesce(F.col("config")["dropout"].try_cast("double"), F.lit(0.0)).alias("dropout"),
        F.coalesce(F.col("config")["emb_size"].try_cast("int"), F.lit(0)).alias("emb_size"),
        F.coalesce(F.col("config")["g_encoder_type"], F.lit("")).alias("g_encoder_type"),
        *[F.col("summary")[key].alias(short) for short, key in SUMMARY_KEYS.items()],
        "created_at",
    ).orderBy("created_at")


def run_fold_scores(runs: DataFrame) -> DataFrame:
    """Per-fold test PCC of finished runs, one row per run and fold year."""
    items = F.explode(F.array(*[F.struct(F.lit(y).alias("fold_year"), F.col("summary")[FOLD_KEY.format(y)].alias("test_pcc")) for y in FOLD_YEARS]))
    long = runs.filter(F.col("state") == FINISHED).select(F.col("id").alias("run_id"), items.alias("f"))
    return long.select("run_id", "f.fold_year", "f.test_pcc").filter("test_pcc is not null")
