"""Feature-selection sweeps.

A ``Sweep`` holds one frame of full vectors with its folds, persisted by the caller;
a candidate set of columns is cut out of the vectors with ``VectorSlicer``, so nothing
is assembled or joined again.  Sets that come up twice are fitted once.  The driver
loops run over column counts and thresholds; every fit is distributed.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.metrics import precision_recall
from churnlens.plans import boosting
from churnlens.plans.models import importances, to_vectors
from churnlens.plans.tune import PARALLELISM, _pmap, cv_means


class Sweep:
    """``df`` has features (vector of ``cols``), label and the fold column."""

    def __init__(self, df: DataFrame, cols, est, fold_col: str = "fold"):
        self.df, self.cols, self.est, self.fold_col = df, list(cols), est, fold_col
        self.spark = df.sparkSession
        self._known: dict[tuple, tuple[float, float]] = {}

    def cut(self, keep, df: DataFrame | None = None) -> DataFrame:
        """``df`` with the vectors reduced to the columns ``keep``."""
        df = self.df if df is None else df
        if list(keep) == self.cols:
            return df
        slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=[self.cols.index(c) for c in keep])
        return slicer.transform(df.withColumnRenamed("features", "_all")).drop("_all")

    def cv(self, keep) -> tuple[float, float]:
        """Mean CV precision and recall on the columns ``keep``."""
        key = tuple(sorted(keep, key=self.cols.index))
        if key not in self._known:
            self._known[key] = cv_means(self.cut(key), self.est, self.fold_col)
        return self._known[key]

    def best_k(self, scores: DataFrame, score_col: str, ks=None) -> tuple[DataFrame, int, list]:
        """For k = 1..n the k best columns by ``score_col``: CV precision and recall.
        The first k of best recall wins.  Returns (table, best k, columns left out)."""
        ranked = [r.feature for r in scores.orderBy(F.desc_nulls_last(score_col), "feature").collect()]
        rows = [(k, *self.cv(ranked[:k])) for k in ks or range(1, len(ranked) + 1)]
        best = max(rows, key=lambda r: (r[2], -r[0]))[0]
        return self.spark.createDataFrame(rows, "k int, precision double, recall double"), best, ranked[best:]

    def single_columns(self) -> DataFrame:
        """(feature, recall): CV recall on each column alone."""
        return self.spark.createDataFrame([(c, self.cv([c])[1]) for c in self.cols], "feature string, recall double")

    def _kept(self, weights: DataFrame, value_col: str, thresholds, strict: bool) -> list[tuple]:
        """Every threshold with the columns that reach (``strict``: exceed) it."""
        value = {r["feature"]: r[value_col] for r in weights.collect()}
        return [(t, [c for c in self.cols if value[c] is not None and (value[c] > t or not strict and value[c] == t)]) for t in thresholds]

    def thresholds(self, weights: DataFrame, value_col: str, thresholds, strict: bool = False):
        """CV precision and recall on the columns whose value reaches (``strict``: exceeds)
        each threshold; no column left: zero.  Returns (table, first best threshold)."""
        rows = [(float(t), len(keep), *(self.cv(keep) if keep else (0.0, 0.0)))
                for t, keep in self._kept(weights, value_col, thresholds, strict)]
        best = max(rows, key=lambda r: (r[3], -r[0]))[0]
        return self.spark.createDataFrame(rows, "threshold double, n_features int, precision double, recall double"), best

    def _path(self, train: DataFrame, step: int, down_to: int):
        """Fits on fewer and fewer columns: yields (columns, model); each time the least
        important ones go (of equals, the first by name)."""
        keep = list(self.cols)
        while True:
            model = self.est.copy().fit(self.cut(keep, train))
            yield keep, model
            if len(keep) <= down_to:
                return
            n = min(step, len(keep) - down_to)
            least = importances(model, keep, self.spark).orderBy("importance", "feature").limit(n).collect()
            keep = [c for c in keep if c not in {r.feature for r in least}]

    def eliminate(self, step: int = 1, min_features: int = 1) -> tuple[DataFrame, list]:
        """Recursive elimination (L8).  Columns are ranked inside each fold, on its training
        rows only, and scored on its held-out rows; the size of best mean recall (the
        smaller of equals) is then reached on all rows.  Returns (table, columns)."""
        folds = sorted(r[0] for r in self.df.select(self.fold_col).distinct().collect())

        def one(f):
            train, held = (self.df.where(F.col(self.fold_col) != f), self.df.where(F.col(self.fold_col) == f))
            found = {}
            for keep, model in self._path(train, step, min_features):
                m = precision_recall(model.transform(self.cut(keep, held)), "label", "prediction", 1.0).first()
                found[len(keep)] = float(m.recall)
            return found

        per_fold = _pmap(one, folds, PARALLELISM)
        rows = [(n, sum(p[n] for p in per_fold) / len(per_fold)) for n in sorted(per_fold[0])]
        best = max(rows, key=lambda r: (r[1], -r[0]))[0]
        columns = next(keep for keep, _ in self._path(self.df, step, best) if len(keep) == best)
        return self.spark.createDataFrame(rows, "n_features int, recall double"), columns


class BoostedSweep(Sweep):
    """A sweep of gradient-boosted trees whose fits run in lock step (``boosting``)."""

    def __init__(self, df: DataFrame, cols, trees: int = 100, depth: int = 3, rate: float = 0.1, fold_col: str = "fold"):
        super().__init__(df, cols, None, fold_col)
        self.trees, self.depth, self.rate = trees, depth, rate
        self.folds = sorted(int(r[0]) for r in df.select(fold_col).distinct().collect())

    def fit(self, models, trees: int | None = None) -> boosting.Fit:
        return boosting.fit(self.df, len(self.cols), models, trees or self.trees, self.rate, self.fold_col)

    def _at(self, keep) -> tuple[int, ...]:
        return tuple(sorted(self.cols.index(c) for c in keep))

    def cv_many(self, sets) -> None:
        """Fit every fold of all sets of columns that are not known yet, together."""
        keys = [k for k in dict.fromkeys(tuple(self.cols[i] for i in self._at(s)) for s in sets) if k and k not in self._known]
        if not keys:
            return
        found = self.fit([boosting.Model(self._at(k), f, self.depth) for k in keys for f in self.folds])
        for i, k in enumerate(keys):
            part = slice(i * len(self.folds), (i + 1) * len(self.folds))
            self._known[k] = float(found.precision[-1, part].mean()), float(found.recall[-1, part].mean())

    def cv(self, keep) -> tuple[float, float]:
        self.cv_many([keep])
        return super().cv(keep)

    def best_k(self, scores: DataFrame, score_col: str, ks=None) -> tuple[DataFrame, int, list]:
        ranked = [r.feature for r in scores.orderBy(F.desc_nulls_last(score_col), "feature").collect()]
        self.cv_many([ranked[:k] for k in ks or range(1, len(ranked) + 1)])
        return super().best_k(scores, score_col, ks)

    def single_columns(self) -> DataFrame:
        self.cv_many([[c] for c in self.cols])
        return super().single_columns()

    def thresholds(self, weights: DataFrame, value_col: str, thresholds, strict: bool = False):
        self.cv_many(kept for _, kept in self._kept(weights, value_col, thresholds, strict))
        return super().thresholds(weights, value_col, thresholds, strict)

    def importances(self) -> DataFrame:
        """(feature, importance) of the boosting fitted on all rows."""
        found = self.fit([boosting.Model(tuple(range(len(self.cols))), None, self.depth)])
        return self.spark.createDataFrame([(c, float(v)) for c, v in zip(self.cols, found.importance[0])], "feature string, importance double")

    def eliminate(self, step: int = 1, min_features: int = 1) -> tuple[DataFrame, list]:
        """As ``Sweep.eliminate``; the folds' paths and that of all rows go down together."""
        keep = {f: list(range(len(self.cols))) for f in [*self.folds, None]}
        whole, rows = {}, []
        while True:
            n = len(keep[None])
            found = self.fit([boosting.Model(tuple(c), f, self.depth) for f, c in keep.items()])
            rows.append((n, float(found.recall[-1, :len(self.folds)].mean())))
            whole[n] = [self.cols[c] for c in keep[None]]
            if n <= min_features:
                break
            for k, (f, cols) in enumerate(keep.items()):
                least = sorted(cols, key=lambda c: (found.importance[k, c], self.cols[c]))[:min(step, n - min_features)]
                keep[f] = [c for c in cols if c not in least]
        best = max(rows, key=lambda r: (r[1], -r[0]))[0]
        return self.spark.createDataFrame(sorted(rows), "n_features int, recall double"), whole[best]

    def grid(self, models: dict, trees: int) -> DataFrame:
        """CV precision and recall of parameter sets ({name: Model parameters}) at ``trees``
        trees, all in one lock step; names are tuples of (parameter, value)."""
        every = tuple(range(len(self.cols)))
        found = self.fit([boosting.Model(every, f, **p) for p in models.values() for f in self.folds], trees)
        k = len(self.folds)
        rows = [(*name, float(found.precision[-1, i * k:(i + 1) * k].mean()), float(found.recall[-1, i * k:(i + 1) * k].mean()))
                for i, name in enumerate(models)]
        names = ", ".join(f"{p} int" for p in next(iter(models.values())))
        return self.spark.createDataFrame(rows, f"{names}, precision double, recall double")

    def tree_counts(self, counts, depth: int) -> DataFrame:
        """CV precision and recall for each number of trees, from one fit of the longest."""
        every = tuple(range(len(self.cols)))
        found = self.fit([boosting.Model(every, f, depth) for f in self.folds], max(counts))
        return self.spark.createDataFrame([(n, float(found.precision[n].mean()), float(found.recall[n].mean())) for n in counts],
                                          "trees int, precision double, recall double")


# The same over a wide frame: feature columns, label, id and fold column.

def _over(df: DataFrame, cols, label: str, id_col: str, est, fold_col: str) -> Sweep:
    return Sweep(to_vectors(df, cols, label, id_col, keep=(fold_col,)), cols, est, fold_col)


def sweep_k(df: DataFrame, scores: DataFrame, score_col: str, est, label: str, id_col: str,
            fold_col: str = "fold", ks=None) -> tuple[DataFrame, int, list]:
    """``Sweep.best_k`` over the scored columns."""
    cols = [r.feature for r in scores.select("feature").collect()]
    return _over(df, cols, label, id_col, est, fold_col).best_k(scores, score_col, ks)


def single_feature_scores(df: DataFrame, cols, est, label: str, id_col: str, fold_col: str = "fold") -> DataFrame:
    return _over(df, cols, label, id_col, est, fold_col).single_columns()


def recursive_elimination(df: DataFrame, cols, est, label: str, id_col: str, fold_col: str = "fold",
                          step: int = 1, min_features: int = 1):
    return _over(df, cols, label, id_col, est, fold_col).eliminate(step, min_features)


def select_from_model(weights: DataFrame, threshold: float, value_col: str) -> list[str]:
    """Columns whose |coefficient| or importance is >= threshold."""
    return [r.feature for r in weights.where(F.col(value_col) >= threshold).orderBy("feature").collect()]


def sweep_threshold(df: DataFrame, weights: DataFrame, value_col: str, thresholds, est, label: str,
                    id_col: str, fold_col: str = "fold"):
    cols = [r.feature for r in weights.select("feature").collect()]
    return _over(df, cols, label, id_col, est, fold_col).thresholds(weights, value_col, thresholds)


def ablate(df: DataFrame, cols, drop, est, label: str, id_col: str, fold_col: str = "fold"):
    """CV (precision, recall) with the named columns removed."""
    return _over(df, cols, label, id_col, est, fold_col).cv([c for c in cols if c not in set(drop)])
