"""Cross-validation, model comparison, grid search and staged tuning.

Folds come from a column (``assign_folds``), so every estimator and every
grid point sees the same folds.  The fold loop and the grid loop are the only
driver-side loops; each fit and each metric is a distributed job over the
persisted vector frame.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.metrics import precision_recall


PARALLELISM = 5


def _pmap(fn, items, parallelism: int):
    """Run independent Spark jobs from a few driver threads (as CrossValidator does)."""
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def cross_validate(df: DataFrame, est, fold_col: str = "fold", positive: float = 1.0,
                   parallelism: int = PARALLELISM) -> DataFrame:
    """Per fold: precision and recall of class ``positive`` after fitting on the
    other folds; returns (fold, precision, recall)."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())

    def one(f):
        model = est.copy().fit(df.where(F.col(fold_col) != f))
        pred = model.transform(df.where(F.col(fold_col) == f))
        m = precision_recall(pred, "label", "prediction", positive).first()
        return (int(f), float(m.precision), float(m.recall))

    rows = _pmap(one, folds, parallelism)
    return df.sparkSession.createDataFrame(rows, "fold int, precision double, recall double")


def cv_means(df: DataFrame, est, fold_col: str = "fold") -> tuple[float, float]:
    """(mean precision, mean recall) over the folds (``train_cv``)."""
    r = cross_validate(df, est, fold_col).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r")).first()
    return float(r.p), float(r.r)


def compare_models(df: DataFrame, estimators: dict, fold_col: str = "fold") -> DataFrame:
    """(model, precision, recall) means for several estimators."""
    rows = _pmap(lambda kv: (kv[0], *cv_means(df, kv[1], fold_col)), list(estimators.items()), 2)
    return df.sparkSession.createDataFrame(rows, "model string, precision double, recall double")


def recall_evaluator(positive: float = 1.0) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=positive,
                                             labelCol="label", predictionCol="prediction")


def grid_search(df: DataFrame, est, grid: dict, fold_col: str = "fold", metric: str = "recall",
                parallelism: int = 4):
    """Exhaustive search over ``grid`` ({param name: values}) with the fold column.

    Returns (best params dict, scores DataFrame of params + mean metric).  The
    first best grid point wins ties (grid order), like the notebook.
    """
    if metric not in ("recall", "precision"):
        raise ValueError("metric is recall or precision")
    pg = ParamGridBuilder()
    for name, values in grid.items():
        pg = pg.addGrid(est.getParam(name), list(values))
    maps = pg.build()
    ev = recall_evaluator() if metric == "recall" else MulticlassClassificationEvaluator(
        metricName="precisionByLabel", metricLabel=1.0)
    k = df.select(fold_col).distinct().count()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=k, parallelism=parallelism)
    model = cv.fit(df)
    names = list(grid)
    rows = []
    for pm, score in zip(maps, model.avgMetrics):
        vals = {p.name: v for p, v in pm.items()}
        rows.append(tuple(str(vals[n]) for n in names) + (float(score),))
    best_i = max(range(len(rows)), key=lambda i: (rows[i][-1], -i))
    best = {p.name: v for p, v in maps[best_i].items()}
    scores = df.sparkSession.createDataFrame(rows, ", ".join([f"{n} string" for n in names] + ["score double"]))
    return best, scores


def tune_stages(df: DataFrame, make_est, grids: list, fold_col: str = "fold", metric: str = "recall"):
    """Run grid searches in sequence, each starting from the best parameters
    of the previous ones (J14).  ``make_est(**params)`` builds the estimator.
    Returns (final params, list of score DataFrames)."""
    params: dict = {}
    tables = []
    for grid in grids:
        best, scores = grid_search(df, make_est(**params), grid, fold_col, metric)
        params.update(best)
        tables.append(scores)
    return params, tables
