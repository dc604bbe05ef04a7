"""Legal but odd inputs: division by zero, single rows, nulls, unknown names."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import neighbors as nbr
from churnlens.operators import prepare as prep
from churnlens.operators import resample
from churnlens.operators import scores as sc
from churnlens.plans import tune


def _table(spark):
    return spark.createDataFrame([(i, float(i % 2), 0.0, 3.0, float(i % 2), float(i)) for i in range(20)],
                                 "id long, y double, zero double, same double, split double, x double")


def test_scores_of_degenerate_columns(spark):
    t = _table(spark)
    chi = {r.feature: r.chi2 for r in sc.chi2_scores(t, ["zero", "x"], "y").collect()}
    assert chi["zero"] is None and chi["x"] is not None
    f = {r.feature: r.f_score for r in sc.f_scores(t, ["same", "split", "x"], "y").collect()}
    assert f["same"] is None and f["split"] is None and f["x"] is not None


def test_mic_has_no_bin_cap(spark):
    # 3,000 rows allow 60 bins; a label that alternates every 50 rows needs them.
    t = spark.range(3000).select("id", F.col("id").cast("double").alias("x"), ((F.col("id") / 50).cast("int") % 2).cast("double").alias("y"))
    assert sc.mic_scores(t, ["x"], "y", "id").first().mic > 0.99


def test_knn_of_any_id_type_equals_numpy(spark):
    rng = np.random.default_rng(0)
    ref, query = rng.integers(0, 4, (70, 3)).astype(float), rng.integers(0, 4, (23, 3)).astype(float)
    to_df = lambda m, p: spark.createDataFrame([(f"{p}{i:03d}", r.tolist(), 0.0) for i, r in enumerate(m)], "id string, x array<double>, y double")
    got = {}
    for r in nbr.knn(to_df(ref, "r"), to_df(query, "q").drop("y"), k=5, block_rows=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.ref_id
    for i, q in enumerate(query):
        order = np.lexsort((np.arange(70), ((ref - q) ** 2).sum(1)))[:5]
        assert [got[f"q{i:03d}"][k] for k in range(5)] == [f"r{j:03d}" for j in order]


def test_knn_of_no_queries_and_of_nulls(spark):
    kind = "id long, x array<double>, y double"
    ref = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 0.0)], kind)
    assert nbr.knn_classify(ref, ref.limit(0)).count() == 0
    with pytest.raises(Exception, match="finite"):
        nbr.knn_classify(ref, spark.createDataFrame([(3, [None], 0.0)], kind)).collect()


def test_smote_with_one_minority_row(spark):
    pts = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 0.0), (3, [2.0], 0.0)], "id long, x array<double>, y double")
    assert resample.smote(pts).count() == 0


def test_unknown_metric_and_row_ids(spark):
    with pytest.raises(ValueError):
        tune.grid_search(_table(spark), None, {}, metric="f1")
    assert prep.with_row_id(_table(spark), ["id", "x"]).select("row_id").distinct().count() == 20
