"""Feature fitting and transforms: a fit is an aggregation, a transform joins its small result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions import expressions as X
from trialspark.operators import ordering as O
from trialspark.schema import TrialError, require_columns
from trialspark.shared import materialize

# Fixed values that results depend on.
CATEGORICAL_COLUMNS = ["Irrigated", "Treatment", "Previous_Crop"]
DROP_WORDS = ["", "false", "0", "off", "none", "no", "drop", "legacy"]
ONEHOT_WORDS = ["true", "1", "on", "yes", "onehot", "one_hot", "ohe"]
MARKER_STD_MIN = 1e-8


# -- environment features ----------------------------------------------------------------

def fit_onehot(df: DataFrame, cols: list[str]) -> DataFrame:
    """Vocabulary ``(column, value)`` observed after normalisation, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), X.normalize_cat(c).alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").distinct()


def apply_onehot(df: DataFrame, vocab: DataFrame, cols: list[str]) -> DataFrame:
    """Replace ``cols`` by 0/1 columns named ``column=value`` in vocabulary order.

    The vocabulary names output columns, so this wide form has to read it here. For large
    vocabularies use ``onehot_ids``, which joins them.
    """
    rows = vocab.orderBy("column", "value").collect()
    added = {f"{r['column']}={r['value']}": (X.normalize_cat(r["column"]) == r["value"]).cast("double") for r in rows if r["column"] in cols}
    return df.withColumns(added).drop(*cols)


def onehot_ids(df: DataFrame, vocab: DataFrame, cols: list[str], out: str = "onehot") -> DataFrame:
    """Replace ``cols`` by the sorted ids of each row's categories, a sparse one-hot vector.

    Ids number the vocabulary in (column, value) order from 0; values outside it have none. Each
    column is one join, however many values there are.
    """
    ids = materialize(O.positions(vocab.select("column", "value").distinct(), [], [F.col("column"), F.col("value")], "__id"))
    for i, c in enumerate(cols):
        one = ids.filter(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), (F.col("__id") - 1).alias(f"__id{i}"))
        df = df.join(one, X.normalize_cat(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"__id{i}") for i in range(len(cols))])))
    return df.withColumn(out, found).drop(*cols, *[f"__id{i}" for i in range(len(cols))])


def preprocess_env(df: DataFrame, mode: str, cols: list[str] | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """``drop`` removes the categorical columns, ``onehot`` encodes them; other words are an error."""
    cols = [c for c in (cols or CATEGORICAL_COLUMNS) if c in df.columns]
    word = mode.strip().lower()
    if word in DROP_WORDS:
        return df.drop(*cols)
    if word in ONEHOT_WORDS:
        return apply_onehot(df, fit_onehot(df, cols) if vocab is None else vocab, cols)
    raise TrialError(f"unknown categorical mode: {mode}")


def align_schema(df: DataFrame, fitted: list[str] | None, keys: list[str], n_fitted: int | None = None) -> DataFrame:
    """Bring features to the fitted order: unseen columns go, missing ones become 0.0.

    Without fitted names only the number of features can be checked.
    """
    require_columns(df, keys, "feature table")
    if fitted is None:
        have = len(df.columns) - len(keys)
        if n_fitted is not None and have != n_fitted:
            raise TrialError(f"expected {n_fitted} features, found {have}")
        return df
    have = set(df.columns)
    return df.select(
        *keys, *[(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in fitted]
    )


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std of each column: ``(feature, mean, std, scale)``, one scan.

    All columns travel as one vector through a single aggregation buffer, so 705 covariates
    cost neither 705 aggregate expressions nor an exploded table.
    """
    vec = array_to_vector(F.array(*[X.coerce_number(c) for c in cols]))
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s"))
    flat = s.select(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n"))
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in cols]), "m", "v")
    long = flat.select(F.inline(zipped), "n").toDF("feature", "mean", "var", "n")
    # the summarizer reports the sample variance
    std = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) * F.when(F.col("n") > 1, (F.col("n") - 1) / F.col("n")).otherwise(0.0))
    return long.select("feature", "mean", std.alias("std"), F.when(std == 0, 1.0).otherwise(std).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame | None, cols: list[str]) -> DataFrame:
    """``(x − mean) / scale`` per column; a missing fit is an error."""
    if scaler is None:
        raise TrialError("scaler must be fitted on the training split first")
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    fitted = scaler.select(place.alias("i"), "mean", "scale").filter("i > 0")
    packed = fitted.agg(F.sort_array(F.collect_list(F.struct("i", "mean", "scale"))).alias("__fit"))  # one entry per column
    joined = df.join(F.broadcast(packed))
    scaled = {c: (X.coerce_number(c) - F.col("__fit")[i]["mean"]) / F.col("__fit")[i]["scale"] for i, c in enumerate(cols)}
    return joined.withColumns(scaled).drop("__fit")


# -- markers -----------------------------------------------------------------------------

def marker_means(df: DataFrame, markers: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean marker vector per group as ``(by…, means)``; one vector buffer per group and task."""
    vec = array_to_vector(F.transform(markers, lambda x: x.cast("double")))
    w = (F.col(weight).cast("double"),) if weight else ()
    return df.groupBy(*by).agg(Summarizer.metrics("mean").summary(vec, *w).alias("s")).select(*by, vector_to_array("s.mean").alias("means"))


def allele_freq(df: DataFrame, by: list[str] | None = None, markers: str = "markers", weight: str | None = None) -> DataFrame:
    """Mean marker value per population and marker: ``(by…, marker, freq)``."""
    by = by or []
    return marker_means(df, markers, by, weight).select(*by, F.posexplode("means").alias("marker", "freq"))


def fit_marker_stats(df: DataFrame, markers: str = "markers") -> DataFrame:
    """``(marker, p, scale, valid)`` from the training rows."""
    p = F.least(F.greatest(F.col("freq"), F.lit(0.0)), F.lit(1.0))
    std = F.sqrt(F.lit(2.0) * F.col("p") * (F.lit(1.0) - F.col("p")))
    # mean dosage is twice the mean marker value, so mean(d)/2 is the frequency itself
    out = allele_freq(df, [], markers).select("marker", p.alias("p")).withColumn("std", std)
    valid = F.col("std") > MARKER_STD_MIN
    return out.select("marker", "p", F.when(valid, F.col("std")).otherwise(1.0).alias("scale"), valid.alias("valid"))


def apply_marker_stats(df: DataFrame, stats: DataFrame, markers: str = "markers", out: str = "z") -> DataFrame:
    """Standardised dosages ``(d − 2p)/scale``, 0 for invalid markers."""
    one = stats.agg(F.sort_array(F.collect_list(F.struct("marker", "p", "scale", "valid"))).alias("__st"))  # one row per marker
    z = F.zip_with(
        X.dosage(markers), "__st", lambda d, s: F.when(s["valid"], (d - F.lit(2.0) * s["p"]) / s["scale"]).otherwise(F.lit(0.0))
    )
    return df.join(F.broadcast(one)).withColumn(out, z).drop("__st")


def hybrid_profiles(
    df: DataFrame, max_hybrids: int | None = None, key: str = "hybrid", markers: str = "markers", seed: int = 42
) -> DataFrame:
    """Mean marker profile of all hybrids, or of ``max_hybrids`` picked by hash order."""
    if max_hybrids is not None:
        picked = df.select(key).distinct().orderBy(X.hash_order(seed, key), key).limit(max_hybrids)
        df = df.join(picked, key, "left_semi")
    return marker_means(df, markers, [key]).select(key, F.posexplode("means").alias("marker", "mean"))


# -- targets and codes -------------------------------------------------------------------

def fit_label_scalers(df: DataFrame, target: str = "yield_mg", env_mean: str = "ymean", resid: str = "resid") -> DataFrame:
    """Mean and population std of total, environment mean and residual: ``(label, mean, std)``."""
    names = {"total": target, "ymean": env_mean, "resid": resid}
    one = df.agg(*[f(c).alias(f"{n}_{t}") for n, c in names.items() for t, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std")) for n in names]))
    return one.select(rows.alias("r")).select("r.*")


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``(value, code)`` with 0-based codes in sorted order."""
    return O.dense_codes(df, [], col, out or f"{col}_code")


def fit_parent_vocab(df: DataFrame) -> DataFrame:
    """1-based ids over the sorted union of parent names.

    Numbering counts the empty name before it is left out, so real names start at 2 when some
    hybrid has no second parent.
    """
    names = df.select(F.explode(F.array("parent1", "parent2")).alias("parent"))
    coded = O.dense_codes(names, [], "parent", "parent_id").withColumn("parent_id", F.col("parent_id") + 1)
    return coded.filter(F.col("parent") != "")


def apply_parent_vocab(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``parent1_id`` and ``parent2_id``; unseen names get 0."""
    for side in ("parent1", "parent2"):
        ids = vocab.select(F.col("parent").alias(side), F.col("parent_id").alias(f"{side}_id"))
        df = df.join(ids, side, "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", F.lit(0)))
    return df


@dataclass(frozen=True)
class Preprocessing:
    """Everything fitted on a training split and reused on the others."""

    scaler: DataFrame | None = None
    label_scalers: DataFrame | None = None
    marker_stats: DataFrame | None = None
    parent_vocab: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "scaler": self.scaler,
            "label_scalers": self.label_scalers,
            "marker_stats": self.marker_stats,
            "parent_vocab": self.parent_vocab,
        }
        return {k: v for k, v in named.items() if v is not None}
