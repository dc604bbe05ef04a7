import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlens.operators import cluster as clu
from churnlens.operators import neighbors as nbr
from churnlens.operators import resample as rs
from churnlens.plans import models as mdl
from churnlens.plans import select as sel
from churnlens.plans import stack as stk
from churnlens.plans import tune as tun
from churnlens.plans.registry import churn_train, vectors_b
from conftest import SF001

B = ["Account Length", "Day Mins", "Day Charge", "Eve Calls", "CustServ Calls"]


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(200, 3))
    q = rng.normal(size=(30, 3))
    rdf = spark.createDataFrame([(i, r.tolist(), float(i % 2)) for i, r in enumerate(ref)], "id long, x array<double>, y double")
    qdf = spark.createDataFrame([(1000 + i, r.tolist()) for i, r in enumerate(q)], "id long, x array<double>")
    got = nbr.knn(rdf.repartition(4), qdf, 3, block_rows=7)
    res = {}
    for r in got.collect():
        res.setdefault(r.query_id, []).append((r.rank, r.ref_id))
    for i, qq in enumerate(q):
        want = np.argsort(((ref - qq) ** 2).sum(1), kind="stable")[:3].tolist()
        assert [rid for _, rid in sorted(res[1000 + i])] == want


def test_smote_reaches_parity(spark):
    pts = nbr.as_points(churn_train(spark, SF001), B, "cust_id", "Churn?")
    counts = {r.y: r["count"] for r in pts.groupBy("y").count().collect()}
    out = rs.oversample(pts, k=5, seed=2)
    c2 = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c2[0.0] == c2[1.0] == max(counts.values())
    s = rs.smote(pts)
    # synthetic points lie on the segment between base and neighbour
    j = s.join(pts.select(F.col("id").alias("base_id"), F.col("x").alias("xb")), "base_id") \
         .join(pts.select(F.col("id").alias("nb_id"), F.col("x").alias("xn")), "nb_id").collect()
    for r in j:
        xb, xn, x = map(np.array, (r.xb, r.xn, r.x))
        t = [(x[i] - xb[i]) / (xn[i] - xb[i]) for i in range(len(x)) if xn[i] != xb[i]]
        assert all(-1e-9 <= v <= 1 + 1e-9 for v in t) and (max(t) - min(t) < 1e-6 if t else True)


def test_relative_distance_and_outliers(spark):
    pts = spark.createDataFrame([(i, [float(v)], 0) for i, v in enumerate([1, 2, 3, 4, 100])], "id long, x array<double>, cluster int")
    cent = spark.createDataFrame([(0, [0.0])], "cluster int, center array<double>")
    s = {r.id: r.score for r in clu.relative_distance(pts, cent).collect()}
    assert s[2] == 1.0 and s[4] == 100 / 3
    assert clu.remove_outliers(clu.relative_distance(pts, cent)).count() == 4


def test_models_cv_grid_and_stack(spark):
    vtr, vte = vectors_b(spark, SF001, B)
    assert {r.fold for r in vtr.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}
    cv = tun.cross_validate(vtr, mdl.logistic()).collect()
    assert len(cv) == 5 and all(0 <= r.recall <= 1 for r in cv)
    best, scores = tun.grid_search(vtr, mdl.forest(numTrees=3), {"maxDepth": [2, 3]})
    assert scores.count() == 2 and best["maxDepth"] in (2, 3)
    params, _ = tun.tune_stages(vtr, lambda **p: mdl.forest(numTrees=3, **p), [{"maxDepth": [2, 3]}, {"numTrees": [2, 4]}])
    assert set(params) == {"maxDepth", "numTrees"}
    st_tr, st_te = stk.stack_features({"a": mdl.forest(numTrees=3), "b": mdl.logistic()}, vtr, vte, "cust_id")
    assert st_tr.count() == vtr.count() and st_te.count() == vte.count()
    pred = stk.fit_stack(mdl.gbt(maxIter=3), st_tr, st_te, ["a", "b"])
    assert pred.count() == vte.count()


def test_selection_sweeps(spark):
    tr = churn_train(spark, SF001)
    from churnlens.operators.split import assign_folds
    tr = tr.join(assign_folds(tr.select("cust_id", "Churn?"), "cust_id", 5, by="Churn?").select("cust_id", "fold"), "cust_id")
    from churnlens.operators.scores import chi2_scores
    table, k, dropped = sel.sweep_k(tr, chi2_scores(tr, B, "Churn?"), "chi2", mdl.logistic(), "Churn?", "cust_id", ks=[1, 2])
    assert table.count() == 2 and k in (1, 2) and len(dropped) == len(B) - k
    fs = sel.single_feature_scores(tr, B[:2], mdl.logistic(), "Churn?", "cust_id")
    assert fs.count() == 2
    rt, cols = sel.recursive_elimination(tr, B[:3], mdl.forest(numTrees=3), "Churn?", "cust_id", min_features=2)
    assert rt.count() == 2 and 2 <= len(cols) <= 3


def test_sse_curve_k1_is_total_ss(spark):
    tr = churn_train(spark, SF001)
    cur = {r.k: r.sse for r in clu.sse_curve(tr, B[:2], [1, 2]).collect()}
    x = np.array([[r[0], r[1]] for r in tr.select(*[F.col(f"`{c}`") for c in B[:2]]).collect()], dtype=float)
    assert abs(cur[1] - ((x - x.mean(0)) ** 2).sum()) < 1e-6 * max(1.0, cur[1])
    assert cur[2] <= cur[1]


def test_pipeline_and_backtest(spark):
    from churnlens.plans.registry import h8_backtest_metrics, h5_pipeline_holdout
    p = h5_pipeline_holdout(spark, SF001)
    assert set(p.columns) >= {"user_id", "predictedLabel"}
    m = h8_backtest_metrics(spark, SF001).first()
    assert 0 <= m.weightedPrecision <= 1 and 0 <= m.weightedRecall <= 1


def test_vector_roundtrip(spark):
    vtr, _ = vectors_b(spark, SF001, B)
    arr = vtr.select(vector_to_array("features").alias("a")).first().a
    assert len(arr) == len(B)
