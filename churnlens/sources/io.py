"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A1 / A2 -------------------------------------------------------------------

def scan_range(df: DataFrame, lo: int, hi: int, day_col: str = "day") -> DataFrame:
    """``where day between lo and hi`` (both ends inclusive).  On a table
    partitioned by ``day`` this prunes partitions."""
    return df.where(F.col(day_col).between(lo, hi))


def scan_snapshot(df: DataFrame, day: int, day_col: str = "day") -> DataFrame:
    """``where day = d`` on a daily full-copy table."""
    return df.where(F.col(day_col) == F.lit(day))


# A3 ------------------------------------------------------------------------

# The telecom churn table: explicit schema instead of inference.
CHURN_SCHEMA = T.StructType([
    T.StructField("cust_id", T.LongType()),
    T.StructField("State", T.StringType()),
    T.StructField("Account Length", T.LongType()),
    T.StructField("Area Code", T.IntegerType()),
    T.StructField("Phone", T.StringType()),
    T.StructField("Int'l Plan", T.StringType()),
    T.StructField("VMail Plan", T.StringType()),
    T.StructField("VMail Message", T.LongType()),
    T.StructField("Day Mins", T.DoubleType()),
    T.StructField("Day Calls", T.LongType()),
    T.StructField("Day Charge", T.DoubleType()),
    T.StructField("Eve Mins", T.DoubleType()),
    T.StructField("Eve Calls", T.LongType()),
    T.StructField("Eve Charge", T.DoubleType()),
    T.StructField("Night Mins", T.DoubleType()),
    T.StructField("Night Calls", T.LongType()),
    T.StructField("Night Charge", T.DoubleType()),
    T.StructField("Intl Mins", T.DoubleType()),
    T.StructField("Intl Calls", T.LongType()),
    T.StructField("Intl Charge", T.DoubleType()),
    T.StructField("CustServ Calls", T.LongType()),
    T.StructField("Churn?", T.StringType()),
])


def read_churn_csv(spark: SparkSession, path: str, schema: T.StructType = CHURN_SCHEMA) -> DataFrame:
    """CSV with a header row, read with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


# A4-A7 ---------------------------------------------------------------------

def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> None:
    """Parquet sink; fails when the path exists unless another mode is given."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """CSV sink with a header.  ``single_file`` funnels all rows through one
    task - only for small result tables."""
    if single_file:
        df = df.repartition(1)  # upstream work keeps its tasks
    df.write.mode(mode).option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# A8, A10, A11 ---------------------------------------------------------------

def register(tables: dict) -> None:
    """Expose DataFrames to SQL users as temp views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def preview(df: DataFrame, n: int, order_by) -> DataFrame:
    """First n rows under a total order (``show(n)`` with a defined answer)."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*cols).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns), like ``DataFrame.shape``."""
    return df.count(), len(df.columns)


def dtype_profile(df: DataFrame) -> DataFrame:
    """Count of columns per Spark type (``dtypes.value_counts()``); schema only."""
    spark = df.sparkSession
    rows = [(t,) for _, t in df.dtypes]
    return (spark.createDataFrame(rows, "dtype string")
            .groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))
            .orderBy(F.desc("n_columns"), "dtype"))


def string_columns(df: DataFrame) -> list[str]:
    """Names of the string columns (``dtypes[dtypes == 'object']``)."""
    return [c for c, t in df.dtypes if t == "string"]
