"""Trial tables and fitted state on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.expressions import ensure_meta
from trialspark.schema import TrialError, TrialSchema, require_columns

# Fixed value that results depend on.
INDEX_COLUMN_PREFIX = "Unnamed"


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    # headers only: types come from the column roles, so no inference pass over the data
    return spark.read.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)


def _drop_index_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(INDEX_COLUMN_PREFIX)])


def read_features(
    spark: SparkSession, path: str, schema: TrialSchema = TrialSchema(), columns: list[str] | None = None, fmt: str = "csv"
) -> DataFrame:
    """Feature table with numbers as doubles; ``columns`` limits the scan to the named columns."""
    df = _drop_index_columns(_read(spark, path, fmt))
    require_columns(df, [schema.id, schema.env], path)
    if columns is not None:
        require_columns(df, columns, path)
        df = df.select(*columns)
    numeric = [c for c in (*schema.markers, *schema.env_numeric) if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric}) if numeric else df


def read_target(spark: SparkSession, path: str, schema: TrialSchema = TrialSchema(), fmt: str = "csv") -> DataFrame:
    """Key and target; unparsable targets stay missing."""
    df = _drop_index_columns(_read(spark, path, fmt))
    require_columns(df, [schema.id, schema.target], path)
    return df.select(schema.id, F.col(schema.target).try_cast("double").alias(schema.target))


def read_trials(
    spark: SparkSession,
    x_path: str,
    y_path: str | None = None,
    schema: TrialSchema = TrialSchema(),
    columns: list[str] | None = None,
    fmt: str = "csv",
) -> tuple[DataFrame, DataFrame | None]:
    """Both trial tables; they are joined on the key later, never by position."""
    x = read_features(spark, x_path, schema, columns, fmt)
    return x, None if y_path is None else read_target(spark, y_path, schema, fmt)


def store_trials(df: DataFrame, path: str) -> str:
    """Write trials with their derived columns, one folder per year, so that year splits and folds
    read only the years they need."""
    ensure_meta(df).write.mode("overwrite").partitionBy("year").parquet(path)
    return path


def save_params(params: dict[str, DataFrame], path: str) -> None:
    """Write each fitted table below ``path``."""
    for name, df in params.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_params(spark: SparkSession, path: str, names: list[str], expect: dict[str, tuple[str, list]] | None = None) -> dict[str, DataFrame]:
    """Read fitted tables back. ``expect`` maps a table to (column, values) its key list must equal,
    for example the marker columns the fit was made on."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    for table, (column, values) in (expect or {}).items():
        want = spark.createDataFrame([(v,) for v in values], out[table].select(column).schema)
        have = out[table].select(column)
        if not have.exceptAll(want).isEmpty() or not want.exceptAll(have).isEmpty():
            raise TrialError(f"{table}: fitted {column} values differ from the expected list")
    return out


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """Write each named result below ``out_dir`` and return the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{out_dir}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
        paths.append(path)
    return paths
