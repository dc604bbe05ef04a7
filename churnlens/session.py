"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session we create ourselves.  A session handed to
# us by a caller is used as it is.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints that nothing refers to any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Parquet pushdown and the vectorised reader stay on (the reference turned
    # both off; there is no reason to on Spark 4).
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "churnlens", master: str | None = None,
                hive: bool = False, conf: dict | None = None) -> SparkSession:
    """Build (or fetch) a SparkSession with churnlens defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    if hive:
        b = b.enableHiveSupport()
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    given.  Only when nothing is configured (local tests) a scratch folder is
    created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="churnlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "churnlens", name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``churnlens`` importable in executor Python workers (once per app).

    Python-side tasks (``mapInPandas``) unpickle functions by module name, so
    the package is zipped and handed to ``addPyFile``, which distributes it
    with the job like any other dependency."""
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="churnlens-pkg-")
    archive = shutil.make_archive(os.path.join(stage, "churnlens"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="churnlens")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
