import tempfile

from churnlens.plans import models as mdl
from churnlens.plans.registry import scored_vectors_a, train_vectors_a
from churnlens.operators import features as feat
from churnlens.plans.registry import h10_scored_features
from churnlens.sources.io import save_model
from churnlens.streaming import start_scoring
from conftest import SF001


def test_stream_scoring_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="churnlens-stream-")
    model = mdl.fit_churn_pipeline(train_vectors_a(spark, SF001))
    save_model(model, f"{base}/model")
    rows = feat.process_features(h10_scored_features(spark, SF001), labelled=False)
    rows.write.parquet(f"{base}/in")
    q = start_scoring(spark, f"{base}/model", f"{base}/in", f"{base}/out", checkpoint=f"{base}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out")
    want = mdl.score(scored_vectors_a(spark, SF001), model)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
