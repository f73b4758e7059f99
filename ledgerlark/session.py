"""Session defaults and the durable work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key also where the next step groups by the same key, at the price of one more shuffle there
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # methods beyond this size are not compiled by the JVM; wide projections then run as split methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # streams keep what they remember of keys on disk, not in executor memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # no call-site capture per expression: large expressions are built twice as fast
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: where a local session without a checkpoint folder keeps its own
OWN_FOLDER = "spark.ledgerlark.workFolder"
#: how often work folders were removed; who remembers a folder asks whether it is still there
releases = 0


def build_session(app: str = "ledgerlark", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session. On a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings the operators count on.

    All timestamps are instants bucketed in UTC, so the session zone must be UTC; the others are
    for skewed keys and wide expressions. Static settings are left alone.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def _base(spark: SparkSession) -> str:
    """The folder of this application's work."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="ledgerlark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(OWN_FOLDER, base)
    return os.path.join(base, f"ledgerlark-{spark.sparkContext.applicationId}")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for checkpoints and written tables.

    It lies under the folder the cluster names in `spark.checkpoint.dir`, with all others of the
    application; `release` removes them. Only a local session without that setting gets a temporary folder of
    its own, which goes when the process ends, since executors on other machines could not read it.
    """
    return os.path.join(_base(spark), f"{label}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Remove the work folders of this application.

    For callers that have written their results: DataFrames that operators returned before can
    no longer be computed afterwards. Streams that go on later keep a store of their own.
    """
    global releases
    releases += 1
    drop_folder(spark, _base(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
