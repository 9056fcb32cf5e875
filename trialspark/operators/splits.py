"""Train / validation / test splits. Every split returns the input with a ``split`` label
(or reports on one); random picks order keys by a seeded digest, so they are repeatable
everywhere and need no global shuffle of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions import expressions as X
from trialspark.operators import ordering as O
from trialspark.operators.population import first_seen
from trialspark.schema import TrialError
from trialspark.shared import materialize

# Fixed values that results depend on.
TRAIN_MAX, VAL_YEAR, TEST_YEAR = 2022, 2023, 2024
LEO_FRACTION, LEO_SEED = 0.15, 42
PROXY_TESTER, PROXY_FRACTION, PROXY_SEED = "PHP02", 0.20, 1
LYGO_MIN_PER_ENV = 4
MIN_VAL_ROWS, MIN_VAL_ENVS = 200, 5
ROLL_START, ROLL_END = 2014, 2023


def _flag(keys: DataFrame, name: str) -> DataFrame:
    return keys.withColumn(name, F.lit(True))


def _left_flag(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Left join that adds a non-NULL boolean telling whether the row's key is in ``keys``."""
    joined = df.join(_flag(keys, name), keys.columns, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False)))


def split_by_year(df: DataFrame, train_max: int = TRAIN_MAX, val_year: int = VAL_YEAR, test_min: int = TEST_YEAR) -> DataFrame:
    """Label by year; years in none of the three ranges get NULL."""
    y = F.col("year")
    label = F.when(y <= train_max, "train").when(y == val_year, "val").when(y >= test_min, "test")
    return df.withColumn("split", label)


def leo_val_envs(df: DataFrame, frac: float = LEO_FRACTION, seed: int = LEO_SEED, test_year: int = TEST_YEAR) -> DataFrame:
    """Environments held out: the first ``max(1, ⌊n·frac⌋)`` of the pool in digest order."""
    pool = materialize(df.filter(F.col("year") < test_year).select("env").distinct())
    ordered = O.positions(pool.withColumn("__h", X.hash_order(seed, "env")), [], [F.col("__h"), F.col("env")])
    n = pool.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * frac)).alias("__n_val"))
    return ordered.join(F.broadcast(n)).filter("position <= __n_val").select("env")  # n is one row


def split_leo(df: DataFrame, frac: float = LEO_FRACTION, seed: int = LEO_SEED, test_year: int = TEST_YEAR) -> DataFrame:
    """Leave-environment-out: val = held-out environments, test = test year on, train = the rest."""
    held = _left_flag(df, leo_val_envs(df, frac, seed, test_year), "__held")
    label = F.when(F.col("year") >= test_year, "test").when(F.col("__held"), "val").otherwise("train")
    return held.withColumn("split", label).drop("__held")


def proxy_parents(
    df: DataFrame, tester: str = PROXY_TESTER, frac: float = PROXY_FRACTION, seed: int = PROXY_SEED, test_year: int = TEST_YEAR
) -> DataFrame:
    """Parents held out per first-year stratum among the tester's rows: ``(parent1, stratum)``."""
    if not 0.0 < frac < 1.0:
        raise TrialError(f"fraction must lie in (0, 1), got {frac}")
    rows = df.filter((F.col("year") < test_year) & (F.col("parent2") == tester))
    first = materialize(rows.groupBy("parent1").agg(F.min("year").alias("stratum")))
    if first.isEmpty():
        raise TrialError(f"no rows before {test_year} for tester {tester}")
    ordered = O.positions(first.withColumn("__h", X.hash_order(seed, "parent1")), ["stratum"], [F.col("__h"), F.col("parent1")])
    sizes = first.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    take = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.col("n") * frac).cast("long")))
    return ordered.join(sizes, "stratum").filter(F.col("position") <= take).select("parent1", "stratum")


def split_proxy_tester(
    df: DataFrame,
    tester: str = PROXY_TESTER,
    frac: float = PROXY_FRACTION,
    seed: int = PROXY_SEED,
    test_year: int = TEST_YEAR,
    leo_envs: DataFrame | None = None,
) -> DataFrame:
    """Same-tester holdout. With ``leo_envs``, validation rows in those environments become
    ``excluded`` (neither trained on nor scored)."""
    picked = proxy_parents(df, tester, frac, seed, test_year).select("parent1")
    out = _left_flag(df, picked, "__picked")
    val = F.col("__picked") & (F.col("parent2") == tester)
    label = F.when(F.col("year") >= test_year, "test").when(val, "val").otherwise("train")
    out = out.withColumn("split", label)
    if leo_envs is not None:
        out = _left_flag(out, leo_envs.select("env"), "__leo")
        out = out.withColumn("split", F.when((F.col("split") == "val") & F.col("__leo"), "excluded").otherwise(F.col("split"))).drop("__leo")
    return out.drop("__picked")


def proxy_diagnostics(split: DataFrame, tester: str = PROXY_TESTER, test_year: int = TEST_YEAR) -> DataFrame:
    """Counts of a proxy split: overall (``year`` NULL) and per year, one aggregation pass.

    ``parent_other_tester_frac`` is the share of held-out parents also crossed with other testers.
    """
    pre = split.filter(F.col("year") < test_year)
    val = F.col("split") == "val"
    counts = pre.groupBy("year", "parent1", "hybrid", "env").agg(
        F.count_if(val).alias("v"), F.count_if(F.col("split") == "excluded").alias("x"), F.count_if(F.col("parent2") != tester).alias("o")
    )
    picked = counts.filter("v > 0")
    yearly = picked.rollup("year").agg(
        F.sum("v").alias("n_rows"),
        F.count_distinct("hybrid").alias("n_hybrids"),
        F.count_distinct("env").alias("n_envs"),
        F.count_distinct("parent1").alias("n_parents"),
    )
    other = counts.groupBy("parent1").agg(F.sum("v").alias("v"), F.sum("o").alias("o")).filter("v > 0")
    extra = other.agg(F.try_divide(F.count_if(F.col("o") > 0), F.count(F.lit(1))).alias("parent_other_tester_frac"))
    removed = counts.agg(F.sum("x").alias("n_removed"))
    return yearly.join(F.broadcast(extra)).join(F.broadcast(removed))  # one-row totals


def test_testers(df: DataFrame, year: int = TEST_YEAR) -> DataFrame:
    """Distinct testers of the test year, without the empty name."""
    return df.filter((F.col("year") == year) & (F.col("parent2") != "")).select(F.col("parent2").alias("tester")).distinct()


test_testers.__test__ = False  # not a test case


def _novelty_key(novelty: str) -> str:
    if novelty not in ("parent1", "hybrid"):
        raise TrialError(f"novelty must be parent1 or hybrid, got {novelty}")
    return novelty


def _lygo_cells(df: DataFrame) -> DataFrame:
    """Row counts per (year, env, hybrid, parents); all LYGO decisions follow from them."""
    return materialize(df.groupBy("year", "env", "hybrid", "parent1", "parent2").agg(F.count(F.lit(1)).alias("n")))


def _lygo_candidates(cells: DataFrame, val_year: int, testers: list[str], novelty: str) -> DataFrame:
    """Cells of the validation year with a target tester and a key never seen earlier."""
    key = _novelty_key(novelty)
    seen = cells.filter(F.col("year") < val_year).select(key).distinct()
    rows = cells.filter((F.col("year") == val_year) & F.col("parent2").isin(list(testers)))
    return rows.join(seen, key, "left_anti")


def split_lygo(
    df: DataFrame, val_year: int, testers: list[str], novelty: str = "parent1", min_val_per_env: int = LYGO_MIN_PER_ENV
) -> DataFrame:
    """Leave-year-and-genotype-out: earlier years train, novel target crosses of the year validate,
    everything else of that year and later is NULL."""
    key = _novelty_key(novelty)
    cells = _lygo_cells(df)
    cand = _lygo_candidates(cells, val_year, testers, novelty)
    envs = cand.groupBy("env").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(1, min_val_per_env)).select("env")
    first = first_seen(cells, key).withColumnRenamed("first_year", "__first")
    out = _left_flag(df.join(first, key), envs, "__env_ok")
    val = (F.col("year") == val_year) & F.col("parent2").isin(list(testers)) & (F.col("__first") == val_year) & F.col("__env_ok")
    return out.withColumn("split", F.when(F.col("year") < val_year, "train").when(val, "val")).drop("__first", "__env_ok")


def lygo_diagnostics(
    df: DataFrame,
    val_year: int,
    testers: list[str],
    novelty: str = "parent1",
    min_val_per_env: int = LYGO_MIN_PER_ENV,
    test_tester_names: list[str] | None = None,
) -> DataFrame:
    """One row describing the validation set, its training side and the warnings that apply."""
    key = _novelty_key(novelty)
    rows = _lygo_cells(df)
    cand = _lygo_candidates(rows, val_year, testers, novelty)
    env_n = materialize(cand.groupBy("env").agg(F.sum("n").alias("env_n")))
    keep = F.col("env_n") >= max(1, min_val_per_env)
    middle = O.medians(env_n.filter(keep), [], "env_n", "m").select(F.coalesce("m", F.lit(0.0)).alias("rows_per_env_median"))
    per_env = env_n.agg(
        F.coalesce(F.sum(F.when(keep, F.col("env_n"))), F.lit(0)).alias("n_val_rows"),
        F.count_if(keep).alias("n_val_envs"),
        F.coalesce(F.min(F.when(keep, F.col("env_n"))), F.lit(0)).alias("rows_per_env_min"),
        F.count_if(~keep).alias("n_envs_dropped"),
        F.count_if(F.col("env_n") < 4).alias("n_envs_below_4"),
    )
    kept = cand.join(env_n.filter(keep).select("env"), "env", "left_semi")
    names = kept.agg(F.count_distinct("parent1").alias("n_val_parents"), F.count_distinct("hybrid").alias("n_val_hybrids"))
    earlier = rows.filter(F.col("year") < val_year)
    train = earlier.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("train_rows"),
        F.count_distinct("parent1").alias("train_parents"),
        F.concat_ws(",", F.sort_array(F.collect_set("year"))).alias("train_years"),
    )
    overlap = kept.select("parent1").distinct().join(earlier.select("parent1").distinct(), "parent1", "left_semi").agg(
        F.count(F.lit(1)).alias("overlap_parents")
    )
    wanted = sorted(set(test_tester_names or []))
    present = F.collect_set(F.when(F.col("parent2").isin(wanted), F.col("parent2")))  # no more than were asked for
    in_year = rows.filter(F.col("year") == val_year).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("year_rows"),
        F.array_join(F.array_except(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), present), ",").alias("testers_missing"),
    )
    row = per_env
    for one in (middle, names, train, overlap, in_year):
        row = row.join(F.broadcast(one))  # every side is a one-row total
    warn: list[Column] = [
        F.when(F.col("n_val_rows") < MIN_VAL_ROWS, F.lit("few_rows")),
        F.when(F.col("n_val_envs") < MIN_VAL_ENVS, F.lit("few_envs")),
        F.when(F.lit(key == "parent1") & (F.col("overlap_parents") > 0), F.lit("parent_overlap")),
        F.when(F.lit(not list(testers)), F.lit("no_testers")),
        F.when(F.col("train_rows") == 0, F.lit("no_training_rows")),
        F.when(F.col("year_rows") == 0, F.lit("no_rows_in_year")),
    ]
    return row.withColumn("warnings", F.array_join(F.array_compact(F.array(*warn)), ","))


def lyngo_sizes(df: DataFrame, years: list[int], min_rows: int = 10) -> DataFrame:
    """Per holdout year: rows of hybrids never seen before, environments, usable ones, novelty %."""
    cells = materialize(df.groupBy("year", "env", "hybrid").agg(F.count(F.lit(1)).alias("n")))
    first = first_seen(cells, "hybrid")
    flagged = cells.filter(F.col("year").isin(years)).join(first, "hybrid").withColumn("novel", F.col("first_year") == F.col("year"))
    hyb = flagged.groupBy("year").agg(
        F.count_distinct("hybrid").alias("h"), F.count_distinct(F.when(F.col("novel"), F.col("hybrid"))).alias("nh")
    )
    envs = flagged.filter("novel").groupBy("year", "env").agg(F.sum("n").alias("n"))
    per = envs.groupBy("year").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_envs"), F.count_if(F.col("n") >= min_rows).alias("n_envs_usable")
    )
    zero = F.lit(0)
    return hyb.join(per, "year", "left").select(
        "year",
        *[F.coalesce(c, zero).alias(c) for c in ("n_rows", "n_envs", "n_envs_usable")],
        (F.col("nh") * 100.0 / F.col("h")).alias("novelty_pct"),
    )


def fold_table(
    spark,
    start: int = ROLL_START,
    end: int = ROLL_END,
    full: bool = False,
    val_years: list[int] | None = None,
    recent_first: bool = False,
    single_year: int | None = None,
    max_folds: int | None = None,
) -> DataFrame:
    """Rolling-origin folds ``(fold_idx, train_year_max, val_year)``; a handful of rows."""
    if end <= start:
        raise TrialError("end year must be after start year")
    use_list = bool(val_years) and not full
    chosen = sorted(set(val_years)) if use_list else list(range(start + 1, end + 1))
    if recent_first:
        chosen = chosen[::-1]
    if single_year is not None:
        if single_year not in chosen:
            raise TrialError(f"{single_year} is not one of the fold years {sorted(chosen)}")
        chosen = [single_year]
    elif max_folds is not None:
        chosen = chosen[: max(1, max_folds)]
    rows = [(i, y - 1, y) for i, y in enumerate(chosen)]
    return spark.createDataFrame(rows, "fold_idx int, train_year_max int, val_year int")


def rolling_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows repeated per fold they belong to, labelled ``train`` or ``val``.

    Every year meets its folds first (both tables have one row per year), so that rows then find
    their folds by an equi-join on the year, whatever the number of folds.
    """
    years = df.select("year").distinct()
    per_year = years.join(folds, F.col("year") <= F.col("val_year"))
    joined = df.join(per_year, "year").select(*df.columns, *folds.columns)
    return joined.withColumn("role", F.when(F.col("year") == F.col("val_year"), "val").otherwise("train"))


def split_random(df: DataFrame, frac: float = 0.8, seed: int = LEO_SEED, key: str = "row_key") -> DataFrame:
    """Train share ``frac`` by the digest of the row key; no shuffle at all."""
    u = X.hash_unit(X.hash_order(seed, key))
    return df.withColumn("split", F.when(u < frac, "train").otherwise("val"))


def cross_tester_holdout(df: DataFrame, tester: str) -> DataFrame:
    """Crosses whose first parent meets ``tester`` exactly once: sizes and other-tester support."""
    cells = df.groupBy("parent1", "parent2", "hybrid", "env").agg(F.count(F.lit(1)).alias("n"))
    crosses = cells.select("parent1", "parent2", "hybrid").distinct()
    per = crosses.groupBy("parent1").agg(
        F.count_if(F.col("parent2") == tester).alias("with_tester"), F.count_if(F.col("parent2") != tester).alias("with_other")
    )
    single = per.filter("with_tester = 1")
    parents = per.agg(
        F.sum("with_tester").alias("n_tester_hybrids"),
        F.count_if(F.col("with_tester") == 1).alias("n_single_parents"),
        F.count_if(F.col("with_tester") > 1).alias("n_multi_parents"),
        F.count_if((F.col("with_tester") == 1) & (F.col("with_other") > 0)).alias("n_supported"),
    )
    held = cells.filter(F.col("parent2") == tester).join(single.select("parent1"), "parent1", "left_semi")
    sizes = held.agg(
        F.count_distinct("hybrid").alias("n_holdout_hybrids"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_holdout_rows"),
        F.count_distinct("env").alias("n_holdout_envs"),
    )
    both = parents.join(F.broadcast(sizes))  # one-row totals
    pct = F.col("n_supported") * 100.0 / F.greatest(F.col("n_single_parents"), F.lit(1))
    return both.select(F.lit(tester).alias("tester"), "*", pct.alias("pct_supported"))


def tester_by_year(df: DataFrame, testers: list[str]) -> DataFrame:
    rows = df.filter(F.col("parent2").isin(list(testers)))
    return rows.groupBy("year", F.col("parent2").alias("tester")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hybrid").alias("n_hybrids")
    )


def novel_parent_summary(df: DataFrame, years: list[int], any_role: bool = True) -> DataFrame:
    """Per year: novel hybrids, their distinct first parents, and how many were known before.

    ``any_role`` counts a parent as known in either role, otherwise only as first parent.
    """
    from trialspark.operators.population import parent_first_seen

    novel = first_seen(df, "hybrid", carry=["parent1"]).filter(F.col("first_year").isin(years))
    known = parent_first_seen(df) if any_role else first_seen(df, "parent1").toDF("parent", "parent_first_year")
    known = known.toDF("parent1", "known_year")
    flagged = novel.join(known, "parent1", "left")
    before = F.col("known_year") < F.col("first_year")
    per = flagged.groupBy(F.col("first_year").alias("year")).agg(
        F.count(F.lit(1)).alias("n_novel"),
        F.count_distinct("parent1").alias("n_parent1"),
        F.count_distinct(F.when(before, F.col("parent1"))).alias("n_known_parent1"),
    )
    return per.withColumn("pct_known", F.try_divide(F.col("n_known_parent1") * 100.0, F.col("n_parent1")))


def tester_matched_years(df: DataFrame, testers: list[str], min_novel: int = 5, top: int = 3, first: int | None = None) -> DataFrame:
    """Per year with history (or from ``first``): novelty %, most common testers of novel hybrids, overlap with the wanted testers,
    mean half-sibs and rows of novel hybrids; years with few novel hybrids are left out."""
    from trialspark.operators.population import half_sib_counts, novelty_by_year

    sibs = half_sib_counts(df)
    per_tester = sibs.filter(F.col("parent2") != "").groupBy("year", "parent2").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("year").orderBy(F.desc("c"), "parent2")  # one row per tester and year
    ranked = per_tester.withColumn("r", F.row_number().over(w))
    item = F.when(F.col("r") <= top, F.struct("r", F.concat("parent2", F.lit("("), F.col("c").cast("string"), F.lit(")")).alias("t")))
    text = ranked.groupBy("year").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), ", ").alias("top_testers"),
        F.count_if(F.col("parent2").isin(list(testers))).alias("tester_overlap"),
    )
    mean = sibs.groupBy("year").agg(F.count(F.lit(1)).alias("n_novel"), F.avg("n_half_sibs").alias("mean_half_sibs"))
    rows = novelty_by_year(df, first=first).select("year", "novelty_pct", "novel_rows")
    out = mean.filter(F.col("n_novel") >= min_novel).join(rows, "year").join(text, "year", "left")
    return out.select(
        "year",
        "n_novel",
        "novelty_pct",
        F.coalesce("top_testers", F.lit("")).alias("top_testers"),
        F.coalesce("tester_overlap", F.lit(0)).alias("tester_overlap"),
        "mean_half_sibs",
        "novel_rows",
    )


def observed_mask(df: DataFrame, leo_envs: DataFrame | None = None, test_year: int = TEST_YEAR) -> DataFrame:
    """Add ``observed``: rows that may feed the decomposition."""
    if leo_envs is None:
        return df.withColumn("observed", F.col("year") < test_year - 1)
    held = _left_flag(df, leo_envs.select("env"), "__held")
    return held.withColumn("observed", (F.col("year") < test_year) & ~F.col("__held")).drop("__held")


def audit_split(split: DataFrame, keys: list[str], left: str = "train", right: str = "val") -> DataFrame:
    """Distinct values of each key on both sides of a split and how many they share."""
    rows = split.filter(F.col("split").isin(left, right))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    sides = rows.select("split", pairs.alias("p")).groupBy("p.key", "p.value").agg(
        F.max(F.col("split") == left).alias("l"), F.max(F.col("split") == right).alias("r")
    )
    return sides.groupBy("key").agg(
        F.count_if(F.col("l")).alias(f"n_{left}"), F.count_if(F.col("r")).alias(f"n_{right}"), F.count_if(F.col("l") & F.col("r")).alias("n_shared")
    )
