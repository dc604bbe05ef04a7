"""Classification metrics from one confusion table.

The confusion table has at most (classes x classes) rows, so every metric is
a tiny aggregate after one grouped pass over the predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("double").alias("label"),
                      F.col(pred).cast("double").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(df: DataFrame, label: str = "label", pred: str = "prediction", positive=1) -> DataFrame:
    """precision and recall of class ``positive`` (0 when undefined, as sklearn)."""
    c = confusion(df, label, pred)
    p = float(positive)
    agg = c.agg(
        F.sum(F.when((F.col("label") == p) & (F.col("prediction") == p), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("prediction") == p, F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("label") == p, F.col("n")).otherwise(0)).alias("ap"))
    return agg.select(
        F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0).alias("precision"),
        F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(0.0).alias("recall"))


def weighted_precision_recall(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """weightedPrecision / weightedRecall as ``MulticlassClassificationEvaluator``:
    per-class precision and recall weighted by the true-class share."""
    c = confusion(df, label, pred)
    tp = c.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    actual = c.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("na"))
    predicted = c.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("np"))
    per = actual.join(tp, "cls", "left").join(predicted, "cls", "left").fillna(0, ["tp", "np"])
    total = F.sum("na").over(Window.partitionBy())  # over the per-class table only
    per = per.withColumn("w", F.col("na") / total)
    return per.agg(
        F.sum(F.col("w") * F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)).alias("weightedPrecision"),
        F.sum(F.col("w") * F.col("tp") / F.col("na")).alias("weightedRecall"))
