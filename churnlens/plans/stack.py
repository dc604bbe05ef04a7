"""Stacking (J15, J16).

For each base model and each fold f: fit on the other folds, predict fold f
(out-of-fold column for the training rows) and predict the test rows; the
test column is the mean of the k fold models' hard predictions.  All pieces
are unions and one grouped average - no positional concatenation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_features(models: dict, train: DataFrame, test: DataFrame, id_col: str,
                   fold_col: str = "fold", use_probability: bool = False):
    """Return (stacked_train, stacked_test): id, one column per model, label.

    ``train`` has id, features, label and the fold column; ``test`` has id,
    features (and label if known)."""
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    out_col = vector_to_array("probability")[1] if use_probability else F.col("prediction")
    tr_parts, te_parts = [], []
    from churnlens.plans.tune import PARALLELISM, _pmap

    for name, est in models.items():
        fitted = _pmap(lambda f: est.copy().fit(train.where(F.col(fold_col) != f)), folds, PARALLELISM)
        oof, tst = [], []
        for f, m in zip(folds, fitted):
            oof.append(m.transform(train.where(F.col(fold_col) == f)).select(id_col, out_col.alias(name)))
            tst.append(m.transform(test).select(id_col, out_col.alias(name)))
        tr_parts.append(reduce(DataFrame.unionByName, oof))
        te_parts.append(reduce(DataFrame.unionByName, tst).groupBy(id_col).agg(F.avg(name).alias(name)))
    st_train = reduce(lambda a, b: a.join(b, id_col), tr_parts).join(train.select(id_col, "label"), id_col)
    st_test = reduce(lambda a, b: a.join(b, id_col), te_parts)
    if "label" in test.columns:
        st_test = st_test.join(test.select(id_col, "label"), id_col)
    return st_train, st_test


def fit_stack(meta, stacked_train: DataFrame, stacked_test: DataFrame, cols) -> DataFrame:
    """Fit the meta classifier on the stacked columns and predict the test rows."""
    from churnlens.plans.models import PARTS

    va = VectorAssembler(inputCols=list(cols), outputCol="features")
    # Kept while the meta model passes over them: they come from joins of every fold's predictions.
    parts = max(PARTS, stacked_train.sparkSession.sparkContext.defaultParallelism)
    rows = va.transform(stacked_train).repartition(parts).persist()
    model = meta.fit(rows)
    rows.unpersist()
    return model.transform(va.transform(stacked_test))
