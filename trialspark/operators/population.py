"""Population, novelty and relatedness analytics.

"Novel in year Y" means first seen in year Y, so one first-seen aggregation answers the question
for every year at once. Half-sibs are counted by inclusion–exclusion over small per-parent
counts; hybrid pairs are never formed.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators import ordering as O
from trialspark.operators.features import allele_freq, marker_means
from trialspark.operators.relations import all_parents, top_values
from trialspark.schema import TrialError
from trialspark.shared import materialize, null_safe_join

# Fixed values that results depend on.
SCORE_NOVELTY, SCORE_TESTER, SCORE_FREQ, SCORE_PARENT, SCORE_SHIFT = 0.3, 0.2, 0.2, 0.15, 0.15
NOVELTY_CAP = 90.0
SHIFT_SMALL, SHIFT_LARGE = 0.1, 0.2


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


# -- first / last seen -------------------------------------------------------------------

def first_seen(df: DataFrame, key: str, carry: list[str] | None = None) -> DataFrame:
    """First year per key; ``carry`` keeps columns that depend on the key only."""
    return df.groupBy(key, *(carry or [])).agg(F.min("year").alias("first_year"))


def last_seen(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max("year").alias("last_year"))


def last_train_year_of_shared(train: DataFrame, test: DataFrame, key: str = "hybrid") -> DataFrame:
    """Histogram of the last training year of keys that also occur in the test rows."""
    shared = train.join(test.select(key).distinct(), key, "left_semi")
    return last_seen(shared, key).groupBy("last_year").agg(F.count(F.lit(1)).alias("n_keys"))


def parent_first_seen(df: DataFrame) -> DataFrame:
    """First year each parent occurs in either role."""
    both = df.select("year", F.explode(F.array("parent1", "parent2")).alias("parent")).filter(F.col("parent") != "")
    return both.groupBy("parent").agg(F.min("year").alias("parent_first_year"))


# -- novelty -----------------------------------------------------------------------------

def _key_sides(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Distinct keys with row counts on both sides."""
    both = train.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _side_counts(prefix: str) -> list[Column]:
    in_a, in_b = F.col("a") > 0, F.col("b") > 0
    return [
        F.count_if(in_a).alias(f"{prefix}_train"),
        F.count_if(in_b).alias(f"{prefix}_test"),
        F.count_if(in_a & in_b).alias(f"{prefix}_shared"),
        F.count_if(in_b & ~in_a).alias(f"{prefix}_novel"),
    ]


def hybrid_novelty(train: DataFrame, test: DataFrame, key: str = "hybrid") -> DataFrame:
    """Distinct hybrids on each side, shared and novel, and test rows with novel hybrids."""
    m = _key_sides(train, test, key).agg(
        *_side_counts("n"), F.sum("b").alias("test_rows"), F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("b"))), F.lit(0)).alias("novel_rows")
    )
    return m.withColumns({"pct_novel": pct(F.col("n_novel"), F.col("n_test")), "pct_novel_rows": pct(F.col("novel_rows"), F.col("test_rows"))})


def env_novelty(train: DataFrame, test: DataFrame) -> DataFrame:
    """Environment and location counts with shared and novel parts, one row per level."""
    out = None
    for key in ("env", "location"):
        one = _key_sides(train, test, key).agg(*_side_counts("n")).select(F.lit(key).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def location_coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per test location: how many and which years it was seen in training."""
    years = train.select("location", "year").distinct()
    seen = years.groupBy("location").agg(F.count(F.lit(1)).alias("n_years"), F.concat_ws(",", F.sort_array(F.collect_list("year"))).alias("years"))
    return test.select("location").distinct().join(seen, "location", "left").select(
        "location", F.coalesce("n_years", F.lit(0)).alias("n_years"), F.coalesce("years", F.lit("")).alias("years")
    )


def from_year(per: DataFrame, years: DataFrame, first: int | None) -> DataFrame:
    """Rows of ``per`` from year ``first`` on; by default from the second observed year of ``years``,
    as everything is new in a year without history."""
    if first is not None:
        return per.filter(F.col("year") >= first)
    base = years.agg(F.min("year").alias("__base"))  # one row
    return per.join(F.broadcast(base), F.col("year") > F.col("__base")).drop("__base")


def novelty_by_year(df: DataFrame, key: str = "hybrid", first: int | None = None) -> DataFrame:
    """Per year with history (or from ``first``): keys, keys never seen in an earlier year, their rows
    and share."""
    cells = materialize(df.groupBy("year", key).agg(F.count(F.lit(1)).alias("n")))
    flagged = cells.join(cells.groupBy(key).agg(F.min("year").alias("first_year")), key)
    novel = F.col("first_year") == F.col("year")
    per = flagged.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(novel).alias("n_novel"), F.coalesce(F.sum(F.when(novel, F.col("n"))), F.lit(0)).alias("novel_rows")
    )
    return from_year(per, cells, first).withColumn("novelty_pct", pct(F.col("n_novel"), F.col("n_keys")))


def turnover(df: DataFrame, key: str = "hybrid") -> DataFrame:
    """Consecutive observed years: sizes and keys shared, as a share of the later year."""
    present = materialize(df.select("year", key).distinct())
    # one row per year
    years = present.select("year").distinct().withColumn("next_year", F.lead("year").over(Window.partitionBy(F.lit(0)).orderBy("year")))
    sizes = present.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    moved = present.join(years.filter("next_year is not null"), "year").select(F.col("year").alias("prev_year"), F.col("next_year").alias("year"), key)
    shared = present.join(moved, ["year", key]).groupBy("prev_year", "year").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = years.filter("next_year is not null").toDF("prev_year", "year")
    out = (
        pairs.join(sizes.toDF("prev_year", "n_prev"), "prev_year")
        .join(sizes, "year")
        .join(shared, ["prev_year", "year"], "left")
        .withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    )
    return out.select("prev_year", "year", "n_prev", "n", "n_shared", pct(F.col("n_shared"), F.col("n")).alias("pct_shared"))


def overlap_by_year(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows, hybrids and locations per training year and how many also occur in the test rows."""
    cells = train.groupBy("year", "hybrid", "location").agg(F.count(F.lit(1)).alias("n"))
    th = test.select("hybrid").distinct().withColumn("h", F.lit(True))
    tl = test.select("location").distinct().withColumn("l", F.lit(True))
    flagged = cells.join(th, "hybrid", "left").join(tl, "location", "left")
    per = flagged.groupBy("year").agg(
        F.sum("n").alias("n_rows"),
        F.count_distinct("hybrid").alias("n_hybrids"),
        F.count_distinct("location").alias("n_locations"),
        F.count_distinct(F.when(F.col("h"), F.col("hybrid"))).alias("hybrid_overlap"),
        F.count_distinct(F.when(F.col("l"), F.col("location"))).alias("location_overlap"),
    )
    return per.withColumn("pct_hybrid_overlap", pct(F.col("hybrid_overlap"), F.col("n_hybrids")))


def yield_by_year(df: DataFrame, target: str = "yield_mg") -> DataFrame:
    return df.groupBy("year").agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.count(F.lit(1)).alias("n"))


def within_env_std(df: DataFrame, target: str = "yield_mg") -> DataFrame:
    """Per year: median, mean and number of the sample std inside each environment."""
    per = materialize(df.groupBy("year", "env").agg(F.stddev_samp(target).alias("std")))
    rest = per.groupBy("year").agg(F.avg("std").alias("mean_std"), F.count("std").alias("n_envs"))
    return null_safe_join(O.medians(per, ["year"], "std", "median_std"), rest, ["year"])


def lifespan_hist(df: DataFrame, key: str = "hybrid") -> DataFrame:
    """How many keys were observed in 1, 2, … distinct years, with shares."""
    span = df.select(key, "year").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_years"))
    hist = span.groupBy("n_years").agg(F.count(F.lit(1)).alias("n_keys"))
    total = hist.agg(F.sum("n_keys").alias("__all"))
    return hist.join(F.broadcast(total)).select("n_years", "n_keys", pct(F.col("n_keys"), F.col("__all")).alias("pct"))  # one-row total


def _with_parent_flags(rows: DataFrame, known: DataFrame) -> DataFrame:
    for side in ("parent1", "parent2"):
        flag = known.select(F.col("parent").alias(side), F.lit(True).alias(f"known_{side}"))
        rows = rows.join(flag, side, "left").withColumn(f"known_{side}", F.coalesce(f"known_{side}", F.lit(False)))
    return rows


def parent_novelty(train: DataFrame, test: DataFrame) -> DataFrame:
    """Parents on each side, and among test rows with novel hybrids the share whose parents are known."""
    pa, pb = all_parents(train), all_parents(test)
    counts = _key_sides(pa, pb, "parent").agg(*_side_counts("parents"))
    cells = test.groupBy("hybrid", "parent1", "parent2").agg(F.count(F.lit(1)).alias("n"))
    novel = cells.join(train.select("hybrid").distinct(), "hybrid", "left_anti")
    k1, k2 = F.col("known_parent1"), F.col("known_parent2")
    total = F.sum("n")

    def share(c: Column) -> Column:
        return pct(F.sum(F.when(c, F.col("n")).otherwise(0)), total)

    rates = _with_parent_flags(novel, pa).agg(
        F.count_distinct("hybrid").alias("n_novel_hybrids"),
        share(k1).alias("pct_known_p1"),
        share(k2).alias("pct_known_p2"),
        share(k1 | k2).alias("pct_any"),
        share(k1 & k2).alias("pct_both"),
    )
    return counts.join(F.broadcast(rates))  # one-row totals


def top_parents(train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """The k most used parents of each role in the test rows, marked known or novel."""
    known = all_parents(train).withColumn("__k", F.lit(True))
    out = None
    for role in ("parent1", "parent2"):
        top = top_values(test, role, k).withColumnRenamed(role, "parent")
        status = F.when(F.col("__k"), "KNOWN").otherwise("NOVEL")
        one = top.join(known, "parent", "left").select(F.lit(role).alias("role"), "parent", "n", status.alias("status"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("role", F.desc("n"), "parent")


def novelty_trajectory(df: DataFrame, first: int | None = None) -> DataFrame:
    """Per year with history (or from ``first``): hybrids, novelty %, and among novel rows the share with known first / both parents."""
    cells = materialize(df.groupBy("year", "env", "hybrid", "parent1", "parent2").agg(F.count(F.lit(1)).alias("n")))
    first_h = cells.groupBy("hybrid").agg(F.min("year").alias("fh"))
    pf = parent_first_seen(cells)
    flagged = (
        cells.join(first_h, "hybrid")
        .join(pf.toDF("parent1", "f1"), "parent1", "left")
        .join(pf.toDF("parent2", "f2"), "parent2", "left")
    )
    novel = F.col("fh") == F.col("year")
    k1, k2 = F.coalesce(F.col("f1") < F.col("year"), F.lit(False)), F.coalesce(F.col("f2") < F.col("year"), F.lit(False))

    def rows(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0))

    per = flagged.groupBy("year").agg(
        F.count_distinct("hybrid").alias("n_hybrids"),
        F.count_distinct(F.when(novel, F.col("hybrid"))).alias("n_novel"),
        F.coalesce(pct(rows(novel & k1), rows(novel)), F.lit(0.0)).alias("pct_known_p1"),
        F.coalesce(pct(rows(novel & k1 & k2), rows(novel)), F.lit(0.0)).alias("pct_both_known"),
        F.count_distinct("env").alias("n_envs"),
    )
    per = from_year(per, cells, first)
    return per.select("year", "n_hybrids", pct(F.col("n_novel"), F.col("n_hybrids")).alias("novelty_pct"), "pct_known_p1", "pct_both_known", "n_envs")


def training_volume(df: DataFrame, y: int) -> DataFrame:
    """Rows and hybrids before year ``y`` against all, with the share missing."""
    per = df.groupBy("hybrid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") < y).alias("b"))
    m = per.agg(
        F.sum("n").alias("rows_all"), F.sum("b").alias("rows_before"), F.count(F.lit(1)).alias("hybrids_all"), F.count_if(F.col("b") > 0).alias("hybrids_before")
    )
    return m.withColumns(
        {
            "pct_rows_lost": pct(F.col("rows_all") - F.col("rows_before"), F.col("rows_all")),
            "pct_hybrids_lost": pct(F.col("hybrids_all") - F.col("hybrids_before"), F.col("hybrids_all")),
        }
    )


# -- half-sibs ---------------------------------------------------------------------------

def half_sib_counts(df: DataFrame, year: int | None = None) -> DataFrame:
    """Per novel hybrid: distinct earlier hybrids sharing a parent in any role.

    ``|sibs(p1)| + |sibs(p2)| − |both|`` over hybrids first seen strictly earlier. Per-parent and
    per-pair yearly counts are accumulated over years, so every holdout year is answered by the
    same equi-joins.
    """
    hybrids = materialize(df.groupBy("hybrid", "parent1", "parent2").agg(F.min("year").alias("year")))
    selfed = F.col("parent1") == F.col("parent2")
    roles = F.when(selfed | (F.col("parent2") == ""), F.array("parent1")).otherwise(F.array("parent1", "parent2"))
    lo, hi = F.least("parent1", "parent2"), F.greatest("parent1", "parent2")

    def earlier(counted: DataFrame, keys: list[str], out: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
        return counted.select(*keys, "year", F.coalesce(F.sum("c").over(w), F.lit(0)).alias(out))

    by_parent = earlier(
        hybrids.select("year", F.explode(roles).alias("p")).filter("p <> ''").groupBy("p", "year").agg(F.count(F.lit(1)).alias("c")), ["p"], "before"
    )
    crosses = hybrids.filter(~selfed & (F.col("parent2") != "") & (F.col("parent1") != ""))
    by_pair = earlier(
        crosses.groupBy(lo.alias("lo"), hi.alias("hi"), "year").agg(F.count(F.lit(1)).alias("c")), ["lo", "hi"], "shared"
    )
    novel = hybrids if year is None else hybrids.filter(F.col("year") == year)
    zero = F.lit(0)
    out = (
        novel.withColumns({"lo": lo, "hi": hi})
        .join(by_parent.toDF("parent1", "year", "b1"), ["parent1", "year"], "left")
        .join(by_parent.toDF("parent2", "year", "b2"), ["parent2", "year"], "left")
        .join(by_pair, ["lo", "hi", "year"], "left")
    )
    second = F.when(selfed | (F.col("parent2") == ""), zero).otherwise(F.coalesce("b2", zero))
    return out.select(
        "hybrid", "year", "parent1", "parent2", (F.coalesce("b1", zero) + second - F.coalesce("shared", zero)).alias("n_half_sibs")
    )


def half_sib_profile(df: DataFrame, year: int | None = None) -> DataFrame:
    """Per holdout year: distribution of half-sib counts and the connected share."""
    s = materialize(half_sib_counts(df, year).select("year", "n_half_sibs"))
    n, c = F.count(F.lit(1)), F.col("n_half_sibs")
    rest = s.groupBy("year").agg(
        n.alias("n_novel"),
        F.avg(c).alias("mean_sibs"),
        F.min(c).alias("min_sibs"),
        F.max(c).alias("max_sibs"),
        pct(F.count_if(c == 0), n).alias("pct_zero"),
        pct(F.count_if(c < 10), n).alias("pct_below_10"),
        pct(F.count_if(c > 100), n).alias("pct_above_100"),
        pct(F.count_if(c > 0), n).alias("pct_connected"),
        F.try_divide(F.sum(c), F.count_if(c > 0)).alias("mean_connected"),
    )
    return null_safe_join(rest, O.medians(s, ["year"], "n_half_sibs", "median_sibs"), ["year"])


def half_sib_rate(df: DataFrame, years: list[int], test_locations: DataFrame, target: str = "yield_mg") -> DataFrame:
    """Per year: share of novel hybrids with a parent seen before, their yield, locations, and how many
    of the test locations are among them."""
    rows = df.filter(F.col("year").isin(years))
    s = half_sib_counts(df).filter(F.col("year").isin(years))
    known = parent_first_seen(df)
    s = s.join(known.toDF("parent1", "f1"), "parent1", "left").join(known.toDF("parent2", "f2"), "parent2", "left")
    has = F.coalesce(F.col("f1") < F.col("year"), F.lit(False)) | F.coalesce(F.col("f2") < F.col("year"), F.lit(False))
    rate = s.groupBy("year").agg(F.count(F.lit(1)).alias("n_novel"), pct(F.count_if(has), F.count(F.lit(1))).alias("half_sib_pct"))
    novel_rows = rows.join(s.select("hybrid", "year"), ["hybrid", "year"], "left_semi")
    stats = novel_rows.groupBy("year").agg(F.avg(target).alias("yield_mean"), F.stddev_samp(target).alias("yield_std"))
    tl = test_locations.select("location").distinct().withColumn("__t", F.lit(1))
    locs = rows.select("year", "location").distinct().join(tl, "location", "left").groupBy("year").agg(
        F.count(F.lit(1)).alias("n_locations"), F.count("__t").alias("shared_locations")
    )
    n_test = tl.agg(F.count(F.lit(1)).alias("test_locations"))  # one row
    out = locs.join(rate, "year", "left").join(stats, "year", "left").join(F.broadcast(n_test))
    return out.select(
        "year", F.coalesce("n_novel", F.lit(0)).alias("n_novel"), "half_sib_pct", "yield_mean", "yield_std", "n_locations", "shared_locations", "test_locations"
    )


def tester_support(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per tester of novel test hybrids: novel crosses, training crosses, rows, years, environments."""
    known = train.select("hybrid").distinct()
    novel = test.select("hybrid", "parent2").filter(F.col("parent2") != "").distinct().join(known, "hybrid", "left_anti")
    wanted = novel.groupBy("parent2").agg(F.count(F.lit(1)).alias("n_novel"))
    cells = train.groupBy("parent2", "hybrid", "year", "env").agg(F.count(F.lit(1)).alias("n"))
    support = cells.groupBy("parent2").agg(
        F.count_distinct("hybrid").alias("n_train_hybrids"),
        F.sum("n").alias("n_rows"),
        F.count_distinct("year").alias("n_years"),
        F.count_distinct("env").alias("n_envs"),
    )
    cols = ["n_train_hybrids", "n_rows", "n_years", "n_envs"]
    out = wanted.join(support, "parent2", "left")
    return out.select(F.col("parent2").alias("tester"), "n_novel", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def difficulty_profile(df: DataFrame, year: int, target: str = "yield_mg") -> DataFrame:
    """One row for a holdout year: half-sib profile, yield spread and environment sizes of novel rows."""
    novel = first_seen(df, "hybrid").filter(F.col("first_year") == year).select("hybrid")
    rows = df.filter(F.col("year") == year).join(novel, "hybrid", "left_semi")
    spread = rows.agg(F.avg(target).alias("yield_mean"), F.stddev_samp(target).alias("yield_std"))
    spread = spread.withColumn("yield_cv", pct(F.col("yield_std"), F.col("yield_mean")))
    sizes = materialize(rows.groupBy("env").agg(F.count(F.lit(1)).alias("n")))
    envs = sizes.agg(F.count(F.lit(1)).alias("n_envs"))
    middle = O.medians(sizes, [], "n", "median_rows_per_env")
    return half_sib_profile(df, year).join(F.broadcast(spread)).join(F.broadcast(envs)).join(F.broadcast(middle))  # one row each


def env_yield_stats(df: DataFrame, min_n: int = 10, target: str = "yield_mg") -> DataFrame:
    """Mean, std and size per environment over rows of hybrids first seen in that year."""
    novel = first_seen(df, "hybrid").withColumnRenamed("first_year", "year")
    rows = df.join(novel, ["hybrid", "year"], "left_semi")
    per = rows.groupBy("env").agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") >= min_n)


def yield_by_env(df: DataFrame, pred: str = "pred", env: str = "env") -> DataFrame:
    return df.groupBy(env).agg(F.avg(pred).alias("mean_pred"))


def top_testers_by_year(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent testers among each year's novel hybrids, with their share."""
    novel = first_seen(df, "hybrid", carry=["parent2"]).withColumnRenamed("first_year", "year")
    per = novel.filter(F.col("parent2") != "").groupBy("year", "parent2").agg(F.count(F.lit(1)).alias("n"))
    total = novel.groupBy("year").agg(F.count(F.lit(1)).alias("__all"))
    w = Window.partitionBy("year").orderBy(F.desc("n"), "parent2")  # one row per tester and year
    ranked = per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(total, "year")
    return ranked.select("year", "rank", F.col("parent2").alias("tester"), "n", pct(F.col("n"), F.col("__all")).alias("pct"))


# -- marker populations ------------------------------------------------------------------

def _set_pairs(freq: DataFrame, label: str) -> DataFrame:
    """Frequencies of two populations side by side per marker, for each pair of labels."""
    left = freq.select(F.col(label).alias("set_a"), "marker", F.col("freq").alias("fa"))
    right = freq.select(F.col(label).alias("set_b"), "marker", F.col("freq").alias("fb"))
    return left.join(right, "marker").filter("set_a < set_b")


def centroid_distance(df: DataFrame, label: str, markers: str = "markers", weight: str | None = None) -> DataFrame:
    """Cosine distance between the mean marker vectors of each pair of row sets.

    ``weight`` says how many plots a row stands for, so markers need not be repeated per plot.
    """
    pairs = _set_pairs(allele_freq(df, [label], markers, weight), label)
    m = pairs.groupBy("set_a", "set_b").agg(
        F.sum(F.col("fa") * F.col("fb")).alias("ab"), F.sum(F.col("fa") * F.col("fa")).alias("aa"), F.sum(F.col("fb") * F.col("fb")).alias("bb")
    )
    return m.select("set_a", "set_b", (F.lit(1.0) - F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb"))).alias("cosine_distance"))


def af_shift(df: DataFrame, label: str, markers: str = "markers", weight: str | None = None) -> DataFrame:
    """Correlation of allele frequencies and markers shifted by more than 0.1 and 0.2 per pair of sets."""
    pairs = _set_pairs(allele_freq(df, [label], markers, weight), label)
    d = F.abs(F.col("fa") - F.col("fb"))
    m = pairs.groupBy("set_a", "set_b").agg(
        F.count(F.lit(1)).alias("n_markers"),
        F.regr_sxx("fb", "fa").alias("saa"),
        F.regr_syy("fb", "fa").alias("sbb"),
        F.regr_sxy("fb", "fa").alias("sab"),
        F.count_if(d > SHIFT_SMALL).alias("n_shift_small"),
        F.count_if(d > SHIFT_LARGE).alias("n_shift_large"),
    )
    r = F.try_divide("sab", F.sqrt("saa") * F.sqrt("sbb"))
    return m.select("set_a", "set_b", "n_markers", r.alias("pcc"), "n_shift_small", "n_shift_large")


def _location_feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    """``year, location, means``: one array of feature means, NULL where a feature has no value.

    Sums and counts of all features travel as one vector through one aggregation buffer.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    there = [F.col(c).isNotNull().cast("double") for c in features]
    sums = df.groupBy("year", "location").agg(Summarizer.metrics("sum").summary(array_to_vector(F.array(*values, *there))).alias("s"))
    both = sums.select("year", "location", vector_to_array("s.sum").alias("v"))
    n = len(features)
    means = F.zip_with(F.slice("v", 1, n), F.slice("v", n + 1, n), lambda total, count: F.try_divide(total, count))
    return both.select("year", "location", means.alias("means"))


def covariate_drift_chain(df: DataFrame, features: list[str], gap: int = 1) -> DataFrame:
    """For each pair of years ``gap`` apart: mean absolute feature difference per shared location,
    then its mean, population std and max over locations."""
    a = materialize(_location_feature_means(df, features))
    b = a.select((F.col("year") - gap).alias("year"), "location", F.col("means").alias("other"))
    apart = F.filter(F.zip_with("means", "other", lambda x, y: F.abs(x - y)), lambda x: x.isNotNull())
    per = a.join(b, ["year", "location"]).select("year", apart.alias("apart"))
    per = per.select("year", F.try_divide(F.aggregate("apart", F.lit(0.0), lambda s, x: s + x), F.size("apart")).alias("d"))
    out = per.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_locations"), F.avg("d").alias("mean_diff"), F.stddev_pop("d").alias("std_diff"), F.max("d").alias("max_diff")
    )
    return out.select("year", (F.col("year") + gap).alias("other_year"), "n_locations", "mean_diff", "std_diff", "max_diff")


def covariate_drift(df: DataFrame, y1: int, y2: int, features: list[str]) -> DataFrame:
    if y1 == y2:
        raise TrialError("years must differ")
    lo, hi = min(y1, y2), max(y1, y2)
    return covariate_drift_chain(df.filter(F.col("year").isin(lo, hi)), features, hi - lo)


def fold_similarity(
    df: DataFrame, test_year: int, key: str = "hybrid", markers: str = "markers", min_novel: int = 5, weight: str | None = None, first: int | None = None
) -> DataFrame:
    """How much the novel set of each earlier year with history (or from ``first``) resembles
    the test year's: novelty, tester and parent overlap, allele-frequency agreement and their score."""
    # one row per year and hybrid with its mean markers; everything below reads this table
    cell = ["year", key, "parent1", "parent2"]
    if weight is None:
        rows = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
        cells = materialize(marker_means(df, markers, cell).join(rows, cell))
    else:
        # rows are such cells already
        cells = materialize(df.select(*cell, F.col(weight).alias("n"), F.col(markers).alias("means")))
    novel = first_seen(cells, key, carry=["parent1", "parent2"]).withColumnRenamed("first_year", "year")
    enough = novel.groupBy("year").agg(F.count(F.lit(1)).alias("n_novel")).filter(F.col("n_novel") >= min_novel)
    total = cells.groupBy("year").agg(F.count_distinct(key).alias("n_all"))
    target = novel.filter(F.col("year") == test_year)
    t_testers = target.filter(F.col("parent2") != "").select("parent2").distinct()
    t_parents = target.select("parent1").distinct()
    earlier = novel.filter(F.col("year") < test_year)
    testers = earlier.join(t_testers, "parent2", "left_semi").groupBy("year").agg(F.count_distinct("parent2").alias("tester_overlap"))
    parents = earlier.join(t_parents, "parent1", "left_semi").groupBy("year").agg(F.count_distinct("parent1").alias("p1_overlap"))
    freq = materialize(allele_freq(cells.join(novel.select(key, "year"), [key, "year"], "left_semi"), ["year"], "means", "n"))
    ref = freq.filter(F.col("year") == test_year).select("marker", F.col("freq").alias("ref"))
    d = F.abs(F.col("freq") - F.col("ref"))
    af = freq.filter(F.col("year") < test_year).join(ref, "marker").groupBy("year").agg(
        F.count(F.lit(1)).alias("m"),
        F.count_if(d > SHIFT_SMALL).alias("n_shift"),
        F.regr_sxx("ref", "freq").alias("sxx"),
        F.regr_syy("ref", "freq").alias("syy"),
        F.regr_sxy("ref", "freq").alias("sxy"),
    )
    one_t = t_testers.agg(F.count(F.lit(1)).alias("n_t"))
    one_p = t_parents.agg(F.count(F.lit(1)).alias("n_p"))
    zero = F.lit(0)
    out = (
        from_year(enough.filter(F.col("year") < test_year), cells, first)
        .join(total, "year")
        .join(testers, "year", "left")
        .join(parents, "year", "left")
        .join(af, "year", "left")
        .join(F.broadcast(one_t))
        .join(F.broadcast(one_p))
    )
    out = out.withColumns(
        {
            "novelty_pct": pct(F.col("n_novel"), F.col("n_all")),
            "tester_overlap": F.coalesce("tester_overlap", zero),
            "p1_overlap": F.coalesce("p1_overlap", zero),
            "n_shift": F.coalesce("n_shift", zero),
            "af_pcc": F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")),
        }
    )
    zero_f, one_f = F.lit(0.0), F.lit(1.0)
    score = (
        F.lit(SCORE_NOVELTY) * F.least(F.col("novelty_pct") / NOVELTY_CAP, one_f)
        + F.lit(SCORE_TESTER) * F.col("tester_overlap") / F.greatest(F.col("n_t"), F.lit(1))
        + F.lit(SCORE_FREQ) * F.greatest(zero_f, F.coalesce("af_pcc", zero_f))
        + F.lit(SCORE_PARENT) * F.col("p1_overlap") / F.greatest(F.col("n_p"), F.lit(1))
        + F.lit(SCORE_SHIFT) * F.greatest(zero_f, one_f - F.coalesce(F.try_divide("n_shift", "m"), zero_f))
    )
    return out.select("year", "n_novel", "novelty_pct", "tester_overlap", "p1_overlap", "af_pcc", "n_shift", score.alias("score"))
