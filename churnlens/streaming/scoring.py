"""Score feature rows as they land, with a stored pipeline (H7 run incrementally).

The reference scores a month in one batch.  When feature rows arrive as
files (one folder per day, say), the same ``PipelineModel`` can be applied by
a Structured Streaming query: a file source with a declared schema, a
stateless ``transform``, and a Parquet sink with a checkpoint folder that the
caller names, so a restarted query neither loses nor repeats files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from churnlens.operators.features import FEATURE_COLS

FEATURE_SCHEMA = T.StructType(
    [T.StructField("user_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLS])


def start_scoring(spark: SparkSession, model_path: str, source_dir: str, sink_dir: str,
                  checkpoint: str, available_now: bool = True,
                  schema: T.StructType = FEATURE_SCHEMA):
    """Start the scoring stream; returns the ``StreamingQuery``.

    ``source_dir`` receives processed feature rows (user_id + the nine
    doubles); ``sink_dir`` gets (user_id, predictedLabel) Parquet files.
    ``checkpoint`` is a folder that stays the same between restarts, one per stream.
    ``available_now`` processes what is there and stops (batch-style runs).
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    model = PipelineModel.load(model_path)
    rows = spark.readStream.schema(schema).parquet(source_dir)
    feats = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features").transform(rows)
    scored = model.transform(feats).select("user_id", "predictedLabel")
    w = scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
