"""Scalar column expressions: name parsing, coercion, marker channels, label scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.schema import TrialError

# Fixed values that results depend on.
UNKNOWN = "UNK"
MISSING_TEXT = ["", "nan", "NaN", "None"]
SCALE_EPS = 1e-8
AFFINE_MIN_SCALE = 1e-4
YEAR_AT_END = r"(\d{4})$"
YEAR_ANYWHERE = r"(20\d{2})"
LOCATION_SUFFIX = r"_\d{4}$"
MODEL_NAME_JUNK = r"[^A-Za-z0-9_.+-]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True when the value is neither NULL, NaN nor infinite; never NULL itself."""
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def env_year(c: str | Column, on_error: str = "raise") -> Column:
    """Trailing four digits of the trimmed environment name; bad names raise (or give NULL)."""
    c = _col(c)
    year = _matched_int(F.trim(c), YEAR_AT_END)
    if on_error == "null":
        return year
    return F.coalesce(year, F.raise_error(F.concat(F.lit("no trailing year in environment: "), F.coalesce(c, F.lit("NULL")))).cast("int"))


def _matched_int(c: Column, pattern: str) -> Column:
    """The number that the pattern's group captures, or NULL. Each name is searched once, also where the result is used in further expressions."""
    return F.regexp_extract(c, pattern, 1).try_cast("int")  # no match gives ''


def env_year_lenient(c: str | Column) -> Column:
    """First ``20xx`` anywhere in the name, or NULL."""
    return _matched_int(_col(c), YEAR_ANYWHERE)


def env_location(c: str | Column) -> Column:
    """Environment name without its year suffix."""
    return F.regexp_replace(_col(c), LOCATION_SUFFIX, "")


def hybrid_name(c: str | Column) -> Column:
    """Text after the first dash; the whole id when there is none."""
    c = _col(c)
    return F.coalesce(F.try_element_at(F.split(c, "-", 2), F.lit(2)), c)


def parent1(c: str | Column) -> Column:
    """Trimmed text before the first slash."""
    return F.trim(F.element_at(F.split(_col(c), "/", 2), 1))


def parent2(c: str | Column) -> Column:
    """Trimmed text after the first slash, ``''`` when there is none."""
    return F.trim(F.coalesce(F.try_element_at(F.split(_col(c), "/", 2), F.lit(2)), F.lit("")))


def split_parents(df: DataFrame, hybrid: str = "hybrid") -> DataFrame:
    return df.withColumns({"parent1": parent1(hybrid), "parent2": parent2(hybrid)})


def ensure_meta(df: DataFrame, id_col: str = "id", env: str = "env") -> DataFrame:
    """Add year, location, hybrid and parents where the table does not have them yet."""
    have = set(df.columns)
    first = {}
    if "year" not in have:
        first["year"] = env_year(env)
    if "location" not in have:
        first["location"] = env_location(env)
    if "hybrid" not in have:
        first["hybrid"] = hybrid_name(id_col)
    if first:
        df = df.withColumns(first)
    parents = {n: f("hybrid") for n, f in (("parent1", parent1), ("parent2", parent2)) if n not in have}
    return df.withColumns(parents) if parents else df


def normalize_cat(c: str | Column) -> Column:
    """Trim; NULL and the usual spellings of "missing" become ``UNK``."""
    trimmed = F.trim(_col(c))
    return F.when(trimmed.isNull() | trimmed.isin(MISSING_TEXT), F.lit(UNKNOWN)).otherwise(trimmed)


def coerce_number(c: str | Column, fill: float | None = 0.0) -> Column:
    """Text to double; unparsable, NULL and NaN become ``fill`` (NULL keeps them missing)."""
    value = _col(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def coerce_numeric(df: DataFrame, cols: list[str], fill: float | None = 0.0) -> DataFrame:
    return df.withColumns({c: coerce_number(c, fill) for c in cols})


def dosage(markers: str | Column) -> Column:
    """Marker values 0 / 0.5 / 1 as allele dosage 0 / 1 / 2."""
    return F.transform(_col(markers), lambda x: x.cast("double") * 2.0)


def tokens(markers: str | Column) -> Column:
    """Half-even rounded dosage as small integers."""
    return F.transform(_col(markers), lambda x: F.bround(x.cast("double") * 2.0).cast("int"))


def additive(dose: str | Column) -> Column:
    return F.transform(_col(dose), lambda d: d - 1.0)


def dominance(dose: str | Column) -> Column:
    return F.transform(_col(dose), lambda d: F.lit(1.0) - F.abs(d - 1.0))


def marker_onehot(token_array: str | Column) -> Column:
    """Three 0/1 indicators per marker."""
    return F.transform(
        _col(token_array),
        lambda t: F.array(*[(t == F.lit(k)).cast("int") for k in (0, 1, 2)]),
    )


def tester_label(c: str | Column) -> Column:
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit(UNKNOWN))


def scale_label(c: str | Column, mean: str | Column, std: str | Column) -> Column:
    return (_col(c) - _col(mean)) / (_col(std) + F.lit(SCALE_EPS))


def unscale_label(c: str | Column, mean: str | Column, std: str | Column) -> Column:
    return _col(c) * (_col(std) + F.lit(SCALE_EPS)) + _col(mean)


def file_stem(path: str | Column) -> Column:
    """Last path segment without its extension."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]+)/?$", 1), r"\.[^.]*$", "")


def clean_model_name(c: str | Column) -> Column:
    """Runs of unsafe characters become one underscore, outer underscores go."""
    return F.regexp_replace(F.regexp_replace(_col(c), MODEL_NAME_JUNK, "_"), r"^_+|_+$", "")


def split_runtime_suffix(c: str | Column) -> tuple[Column, Column]:
    """``base__suffix`` → (base, suffix); suffix is ``''`` when there is no separator."""
    parts = F.split(_col(c), "__", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def softplus(c: str | Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    c = _col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def apply_env_affine(preds: DataFrame, params: DataFrame, rank_pred: str = "rank_pred", env: str = "env") -> DataFrame:
    """Calibrated total ``(softplus(a)+1e-4)·rank + b`` with per-environment ``a_env, b_env``."""
    joined = preds.join(params.select(env, "a_env", "b_env"), env, "left")
    return joined.withColumn(
        "total_pred", (softplus("a_env") + F.lit(AFFINE_MIN_SCALE)) * F.col(rank_pred) + F.col("b_env")
    )


def recompose_total(df: DataFrame, env_mean_pred: str = "ymean_pred", resid_pred: str = "resid_pred") -> DataFrame:
    return df.withColumn("total_pred", F.col(env_mean_pred) + F.col(resid_pred))


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """Deterministic shuffle order: hex digest of seed and keys, equal in every SQL engine."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), _col(k).cast("string")]
    return F.md5(F.concat(*parts))


def hash_unit(digest: Column) -> Column:
    """Map a hex digest to (0, 1) by its first twelve digits."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def all_of(conditions: list[Column]) -> Column:
    if not conditions:
        raise TrialError("no conditions given")
    return reduce(lambda a, b: a & b, conditions)
