"""Estimators, the churn pipeline, scoring and back-testing (H1-H8, K1-K9)."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.features import FEATURE_COLS, add_label
from churnlens.operators.metrics import weighted_precision_recall

PARTS = 24


def to_vectors(df: DataFrame, cols, label: str | None, id_col: str, out: str = "features", keep=()) -> DataFrame:
    """(id, features vector, label double, ``keep`` columns) - the frame every estimator reads."""
    va = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")
    sel = [F.col(f"`{id_col}`").alias(id_col), out]
    if label is not None:
        sel.append(F.col(f"`{label}`").cast("double").alias("label"))
    return va.transform(df).select(*sel, *keep)


def dealt(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` dealt by id to as many partitions as there are cores, at least ``PARTS``.  A fit
    passes over its rows hundreds of times, and a task a shuffle partition costs more there
    than its rows; from ``PARTS`` cores down the rows of a partition do not depend on them."""
    return df.repartition(max(PARTS, df.sparkSession.sparkContext.defaultParallelism), id_col)


# K1-K7 -----------------------------------------------------------------------

def logistic(C: float | None = None, penalty: str = "none", n: int | None = None, **kw):
    """Logistic regression.  ``C`` with ``n`` training rows maps sklearn's
    inverse strength to Spark's ``regParam = 1 / (C n)``; ``penalty='l1'``
    sets ``elasticNetParam=1``.  Without ``C`` it is the unregularised default."""
    p = dict(maxIter=100, standardization=False, **kw)
    if C is not None and penalty != "none":
        if not n:
            raise ValueError("n (training rows) is needed to translate C")
        p["regParam"] = 1.0 / (C * n)
        p["elasticNetParam"] = 1.0 if penalty == "l1" else 0.0
    return LogisticRegression(**p)


def linear_svc(**kw):
    """Linear support-vector classifier (the reference's RBF SVC re-aimed)."""
    return LinearSVC(**{"maxIter": 100, **kw})


class FourierFeatures(Transformer):
    """Random Fourier features of the kernel exp(-gamma |x - z|^2): ``size`` values
    sqrt(2 / size) cos(w x + b) with w from N(0, 2 gamma) and b from [0, 2 pi), drawn by
    ``seed`` for ``columns`` inputs.  A column expression; the table of weights is a literal
    of size x (columns + 1) numbers."""

    def __init__(self, columns: int, size: int = 256, gamma: float | None = None, seed: int = 0,
                 input_col: str = "features", output_col: str = "fourier"):
        super().__init__()
        self.columns, self.size, self.seed = columns, size, seed
        self.gamma = 1.0 / columns if gamma is None else gamma
        self.input_col, self.output_col = input_col, output_col

    def weights(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=np.sqrt(2 * self.gamma), size=(self.size, self.columns))
        return np.hstack([w, rng.uniform(0, 2 * np.pi, size=(self.size, 1))])

    def _transform(self, df: DataFrame) -> DataFrame:
        table = F.from_json(F.lit(str(self.weights().tolist())), "array<array<double>>")
        x = F.concat(vector_to_array(self.input_col), F.array(F.lit(1.0)))
        dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return df.withColumn(self.output_col, array_to_vector(F.transform(table, lambda w: F.cos(dot(w)) * float(np.sqrt(2 / self.size)))))


def kernel_svc(columns: int, size: int = 256, gamma: float | None = None, seed: int = 0, **kw) -> Pipeline:
    """Support-vector classifier with an RBF kernel (K4) over ``columns`` standardised
    features, by ``size`` random Fourier features; ``gamma`` is 1 / columns by default."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                            FourierFeatures(columns, size, gamma, seed, "scaled", "fourier"),
                            LinearSVC(**{"featuresCol": "fourier", "maxIter": 100, "regParam": 1e-3, **kw})])


def forest(numTrees: int = 20, maxDepth: int = 5, featureSubsetStrategy: str = "auto",
           minInstancesPerNode: int = 1, seed: int = 0, **kw):
    return RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth,
                                  featureSubsetStrategy=featureSubsetStrategy,
                                  minInstancesPerNode=minInstancesPerNode, seed=seed, **kw)


def gbt(maxIter: int = 20, stepSize: float = 0.1, maxDepth: int = 5, minInstancesPerNode: int = 1,
        seed: int = 0, **kw):
    return GBTClassifier(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth,
                         minInstancesPerNode=minInstancesPerNode, seed=seed, **kw)


# The notebook's tuned models (min_samples_split has no Spark
# counterpart; leaf size maps to minInstancesPerNode).
TUNED_GBT = dict(maxIter=78, stepSize=0.1, maxDepth=5, minInstancesPerNode=1)
TUNED_FOREST = dict(numTrees=75, maxDepth=7, featureSubsetStrategy="5", minInstancesPerNode=1)


def importances(model, cols, spark=None) -> DataFrame:
    """(feature, importance) of a fitted tree model, descending (K8)."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    imp = model.featureImportances.toArray().tolist()
    rows = [(c, float(v)) for c, v in zip(cols, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def coefficients(model, cols, spark=None) -> DataFrame:
    """(feature, coefficient, abs) of a fitted linear model."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    coef = model.coefficients.toArray().tolist()
    return spark.createDataFrame([(c, float(v), abs(float(v))) for c, v in zip(cols, coef)],
                                 "feature string, coefficient double, abs_coefficient double")


def fit_predict(est, train: DataFrame, test: DataFrame, keep=("label",)) -> DataFrame:
    """Fit on ``train``, predict ``test`` (K9)."""
    model = est.fit(train)
    out = model.transform(test)
    return out


# H2-H8 -----------------------------------------------------------------------

def fit_churn_pipeline(train: DataFrame, max_categories: int = 10, fit_index_on: DataFrame | None = None) -> PipelineModel:
    """Fit the half-A model.  Indexers are fitted on ``train`` unless
    ``fit_index_on`` is given (the reference fits them on all rows)."""
    basis = fit_index_on if fit_index_on is not None else train
    label_model = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(basis)
    feat_model = VectorIndexer(inputCol="features", outputCol="indexedFeatures",
                               maxCategories=max_categories, handleInvalid="keep").fit(basis)
    lr = LogisticRegression(labelCol="indexedLabel", featuresCol="indexedFeatures")
    to_label = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_model.labels)
    return Pipeline(stages=[label_model, feat_model, lr, to_label]).fit(train)


def score(df: DataFrame, model: PipelineModel, id_col: str = "user_id") -> DataFrame:
    """Batch scoring: (id, predictedLabel) (H7)."""
    return model.transform(df).select(id_col, "predictedLabel")


def join_later_state(pred: DataFrame, users: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Predictions joined to a later account snapshot."""
    return pred.join(users, pred[id_col] == users["nns_id"], "inner").drop("nns_id", "day")


def backtest(pred: DataFrame, users: DataFrame, id_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Compare predictions with a later snapshot: returns (rows, metrics).

    rows = (id, predictedLabel double, label double); any state other than 4/5
    counts as 0.  Metrics = weightedPrecision / weightedRecall (the reference
    printed weightedPrecision twice; recall is the recall here).
    """
    j = join_later_state(pred, users, id_col)
    rows = add_label(j.select(id_col, F.col("predictedLabel").cast("double").alias("predictedLabel"),
                              F.col("nns_state").cast("double").alias("nns_state")), as_double=True)
    return rows, weighted_precision_recall(rows, "label", "predictedLabel")


def holdout_metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    """weightedPrecision / weightedRecall of the fitted pipeline on held-out rows."""
    return weighted_precision_recall(model.transform(test), "indexedLabel", "prediction")


FEATURES_A = FEATURE_COLS
