"""Typing and shaping of the telecom table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import flag

ID_COL = "cust_id"
LABEL_COL = "Churn?"
# Columns dropped and flags encoded by the reference notebook.
DROP_COLS = ["State", "Area Code", "Phone"]
FLAG_VALUES = {"Churn?": "True.", "Int'l Plan": "yes", "VMail Plan": "yes"}
CROSS_PARTS = {
    "Charge": ["Day Charge", "Eve Charge", "Night Charge"],
    "Mins": ["Day Mins", "Eve Mins", "Night Mins"],
    "Calls": ["Day Calls", "Eve Calls", "Night Calls"],
}
FEATURES = ["Account Length", "Int'l Plan", "VMail Plan", "VMail Message",
            "Day Mins", "Day Calls", "Day Charge", "Eve Mins", "Eve Calls", "Eve Charge",
            "Night Mins", "Night Calls", "Night Charge", "Intl Mins", "Intl Calls", "Intl Charge",
            "CustServ Calls"]


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def encode_flags(df: DataFrame, flags: dict = FLAG_VALUES) -> DataFrame:
    """Text flags to 0/1 ints in place."""
    out = df
    for c, true_value in flags.items():
        out = out.withColumn(c, flag(c, true_value))
    return out


def prepare_churn(df: DataFrame) -> DataFrame:
    """Drop State / Area Code / Phone and encode the three flags."""
    return encode_flags(drop_columns(df, DROP_COLS))


def add_cross_features(df: DataFrame, drop_parts: bool = True) -> DataFrame:
    """Charge and Mins = day + eve + night; Calls = the three call counts minus
    customer-service calls; the nine parts are dropped (B14)."""
    out = df
    for name, parts in CROSS_PARTS.items():
        total = F.col(f"`{parts[0]}`") + F.col(f"`{parts[1]}`") + F.col(f"`{parts[2]}`")
        if name == "Calls":
            total = total - F.col("`CustServ Calls`")
        out = out.withColumn(name, total)
    if drop_parts:
        out = out.drop(*[p for ps in CROSS_PARTS.values() for p in ps])
    return out


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_null) for every column, one aggregate pass, fewest nulls first."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(92) + chr(39))}', n{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {stack}) as (column, n_null)").orderBy("n_null", "column")


def with_row_id(df: DataFrame, keys, out: str = "row_id") -> DataFrame:
    """A stable row id from key columns (never from position)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if len(keys) == 1:
        return df.withColumn(out, F.col(keys[0]))
    return df.withColumn(out, F.struct(*keys))  # exact: a hash could collide


def repeated_keys(df: DataFrame, keys) -> DataFrame:
    """(keys, n) of the keys that occur more than once; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_on_row_id(left: DataFrame, right: DataFrame, id_col: str = ID_COL) -> DataFrame:
    """Column-wise concatenation by id (``pd.concat(axis=1)`` without positions)."""
    return left.join(right, id_col, "inner")


def rename_all(df: DataFrame, names) -> DataFrame:
    return df.toDF(*names)
