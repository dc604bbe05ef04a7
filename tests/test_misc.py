from pyspark.sql import functions as F

from churnlens.operators import prepare as prep
from churnlens.operators import scores as sc
from churnlens.plans import models as mdl
from churnlens.plans import select as sel
from churnlens.plans.registry import churn_train, vectors_b
from churnlens.sources.io import dtype_profile, preview, shape, string_columns
from conftest import SF001

B = ["Account Length", "Day Mins", "Day Charge", "Eve Calls", "CustServ Calls"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "i long, s string, d double")
    assert string_columns(df) == ["s"]
    assert {r.dtype: r.n_columns for r in dtype_profile(df).collect()} == {"bigint": 1, "string": 1, "double": 1}
    assert {r.column: r.n_null for r in prep.null_profile(df).collect()} == {"i": 0, "s": 1, "d": 1}
    assert shape(df) == (2, 3)
    assert [r.i for r in preview(df, 1, "i").collect()] == [1]


def test_first_best_and_means(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "k int, v double")
    assert sc.first_best(s, "k", "v").first().k == 2  # first maximum wins
    f = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7)], "m string, fold int, r double")
    assert sc.mean_scores(f, ["m"], ["r"]).first().r == 0.6


def test_cross_features_and_rename(spark):
    row = {c: 1.0 for c in prep.FEATURES}
    row.update({"cust_id": 1, "Churn?": 0, "CustServ Calls": 2.0})
    df = spark.createDataFrame([row])
    x = prep.add_cross_features(df).first()
    assert x.Charge == 3.0 and x.Mins == 3.0 and x.Calls == 1.0
    assert "Day Charge" not in prep.add_cross_features(df).columns
    assert prep.rename_all(df.select("cust_id"), ["id"]).columns == ["id"]
    assert prep.with_row_id(df, "cust_id").first().row_id == 1


def test_threshold_selection_and_ablation(spark):
    tr = churn_train(spark, SF001)
    from churnlens.operators.split import assign_folds
    tr = tr.join(assign_folds(tr.select("cust_id", "Churn?"), "cust_id", 5, by="Churn?").select("cust_id", "fold"), "cust_id")
    vtr, _ = vectors_b(spark, SF001, B)
    imp = mdl.importances(mdl.forest(numTrees=5).fit(vtr), B)
    keep = sel.select_from_model(imp, 0.0, "importance")
    assert set(keep) == set(B)
    table, best_t = sel.sweep_threshold(tr, imp, "importance", [0.0, 2.0], mdl.logistic(), "Churn?", "cust_id")
    rows = {r.threshold: r for r in table.collect()}
    assert rows[2.0].n_features == 0 and rows[2.0].recall == 0.0 and best_t in (0.0, 2.0)
    p, r = sel.ablate(tr, B, ["Eve Calls"], mdl.logistic(), "Churn?", "cust_id")
    assert 0 <= p <= 1 and 0 <= r <= 1
    coef = mdl.coefficients(mdl.logistic(1.0, "l1", vtr.count()).fit(vtr), B)
    assert coef.count() == len(B) and coef.where(F.col("abs_coefficient") < 0).count() == 0
