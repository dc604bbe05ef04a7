"""The per-user feature row and its processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.orders import order_features, search_features
from churnlens.operators.viewing import viewing_features

FEATURE_COLS = ["user_time", "device_freq", "device_uni", "vod_time", "live_time",
                "userSearch", "userOther", "userOffer", "userCancel"]

# The reference's null fills.
FILL_DEFAULTS = {
    "vod_time": 10215.79,
    "live_time": 20872.1,
    "userSearch": -1,
    "userOther": -1,
    "userOffer": -1,
    "userCancel": -1,
}
FEATURE_COLS_OUT = ["user_id", *FEATURE_COLS, "nns_state"]
LABEL_STATES = (0, 4, 5)
CHURN_STATES = (4, 5)


def join_features(base: DataFrame, *parts: DataFrame, key: str = "user_id") -> DataFrame:
    """Left-join per-user parts onto ``base`` (every part is unique on ``key``)."""
    out = base
    for p in parts:
        out = out.join(p, key, "left")
    return out


def attach_state(features: DataFrame, users: DataFrame, states=LABEL_STATES) -> DataFrame:
    """Inner join with the account snapshot, keeping users in ``states``."""
    u = users.where(F.col("nns_state").isin(list(states))).select(
        F.col("nns_id").alias("user_id"), "nns_state")
    return features.join(u, "user_id", "inner")


def build_features(play: DataFrame, log: DataFrame, orders: DataFrame, users: DataFrame | None = None,
                   order_window=None, require_label: bool = True, states=LABEL_STATES) -> DataFrame:
    """One feature row per user (H9 with ``require_label``; H10 without).

    Three pre-aggregates (plays, user log, orders) joined on the user key; the
    joins see one row per user on each side.
    """
    f = join_features(viewing_features(play), search_features(log), order_features(orders, order_window))
    f = f.select("user_id", *FEATURE_COLS)
    if require_label:
        if users is None:
            raise ValueError("require_label needs the account snapshot")
        f = attach_state(f, users, states)
    return f


def fill_features(df: DataFrame, defaults: dict = FILL_DEFAULTS) -> DataFrame:
    """Per-column constant null fill."""
    out = df
    for c, v in defaults.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(out.schema[c].dataType)))
    return out


def cast_features(df: DataFrame, cols=FEATURE_COLS, label: str | None = None, keep=("user_id",)) -> DataFrame:
    """Feature columns to double, label to int."""
    sel = [F.col(k) for k in keep if k in df.columns]
    sel += [F.col(c).cast("double").alias(c) for c in cols]
    if label is not None:
        sel.append(F.col(label).cast("int").alias(label))
    return df.select(*sel)


def add_label(df: DataFrame, state_col: str = "nns_state", positive=CHURN_STATES,
              label_col: str = "label", drop_state: bool = True, as_double: bool = False) -> DataFrame:
    """label = 1 when the state is one of ``positive`` else 0 (null state -> 0)."""
    lab = F.when(F.col(state_col).isin(list(positive)), 1).otherwise(0)
    out = df.withColumn(label_col, lab.cast("double") if as_double else lab)
    return out.drop(state_col) if drop_state else out


def process_features(df: DataFrame, labelled: bool = True) -> DataFrame:
    """Fill, cast and label - the reference's train/test feature processing before assembly."""
    f = fill_features(df)
    if labelled:
        f = cast_features(f, label="nns_state")
        return add_label(f)
    return cast_features(f)


def assemble(df: DataFrame, cols=FEATURE_COLS, keep=("user_id", "label"), out: str = "features") -> DataFrame:
    """``VectorAssembler`` over the feature columns (nulls must be filled first)."""
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")
    return va.transform(df).select(*[k for k in keep if k in df.columns], out)
